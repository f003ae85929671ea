"""Change-log and set-operation queries. events stand in for a log: user_id is the tag."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark.operators import relational as R
from vecspark.sources import manifest
from vecspark.streaming import apply_changes

from .common import G_SQL, base, load, near_graph, registrar

REGISTRY, add = registrar()
LOG = "L AS (SELECT event_id AS seq, user_id AS tag, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'insert' END AS op FROM events)"


def log(spark, d):
    e = load(spark, d, "events")
    least = e.agg(F.min("event_type").alias("least"))
    return e.join(F.broadcast(least)).select(F.col("event_id").alias("seq"), F.col("user_id").alias("tag"), F.when(F.col("event_type") == F.col("least"), "delete").otherwise("insert").alias("op"))


@add("t3_t10_active_tags", f"WITH {LOG} SELECT tag, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq DESC) AS r FROM L WHERE tag <> 0) WHERE r = 1 AND op = 'insert'")
def active(spark, d):
    return R.live_rows(log(spark, d))


@add("t4_u4_failed_deletes", f"WITH {LOG}, P AS (SELECT *, lag(op) OVER (PARTITION BY tag ORDER BY seq) AS before FROM L) SELECT seq, tag FROM P WHERE op = 'delete' AND (before IS NULL OR before = 'delete' OR tag = 0)")
def failed(spark, d):
    before = F.lag("op").over(Window.partitionBy("tag").orderBy("seq"))
    return log(spark, d).withColumn("before", before).where("op = 'delete' and (before is null or before = 'delete' or tag = 0)").select("seq", "tag")


@add("t1_t2_batched_log", f"WITH {LOG} SELECT tag, max(seq) AS seq, arg_max(op, seq) AS op FROM L WHERE tag <> 0 GROUP BY tag")
def batched(spark, d):
    """The log in two halves gives what the whole gives."""
    x = log(spark, d)
    return apply_changes(apply_changes(x.limit(0), x.where("seq % 2 = 0")), x.where("seq % 2 = 1"))


@add("j23_t5_delete_repair", f"WITH {G_SQL}, D AS (SELECT id FROM E WHERE id % 10 = 3), A AS (SELECT src, dst FROM G WHERE src NOT IN (SELECT id FROM D)), K AS (SELECT src, dst FROM A WHERE dst NOT IN (SELECT id FROM D) UNION SELECT A.src, G.dst FROM A JOIN G ON A.dst = G.src WHERE A.dst IN (SELECT id FROM D) AND G.dst NOT IN (SELECT id FROM D) AND A.src <> G.dst) SELECT src, dst FROM K")
def repair(spark, d):
    e = base(spark, d)
    return R.repair_edges(near_graph(spark, d), e.where("id % 10 = 3").select("id"))


@add("a39_consolidation_report", "SELECT count(*) AS total, count(*) FILTER (vec_id % 10 = 3) AS deleted, count(*) FILTER (vec_id % 10 <> 3) AS active FROM embeddings")
def report(spark, d):
    dead = (F.col("vec_id") % 10 == 3).cast("long")
    return load(spark, d, "embeddings").agg(F.count("*").alias("total"), F.sum(dead).alias("deleted"), F.sum(1 - dead).alias("active"))


@add("t6_compaction", "SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE vec_id % 10 <> 3")
def compact(spark, d):
    """New dense ids, counted by ranges, so no task sees all rows."""
    e = load(spark, d, "embeddings").where("vec_id % 10 <> 3").select(F.col("vec_id").alias("old_id"))
    return R.numbered(e, "old_id", "new_id").select("old_id", "new_id")


@add("u1_u3_pool_union", f"WITH {G_SQL} SELECT src, count(*) AS either, sum((n = 2)::INT)::BIGINT AS both FROM (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM G WHERE pos <= 6 UNION ALL SELECT src, dst FROM G WHERE pos >= 4) GROUP BY ALL) GROUP BY src")
def pools(spark, d):
    g = near_graph(spark, d)
    n = g.where("pos <= 6").select("src", "dst").unionByName(g.where("pos >= 4").select("src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.groupBy("src").agg(F.count("*").alias("either"), F.sum((F.col("n") == 2).cast("long")).alias("both"))


@add("u2_merge_shards", f"WITH {G_SQL}, M AS (SELECT src, dst, min(distance) AS distance FROM (SELECT src, dst, distance FROM G UNION ALL SELECT dst, src, distance FROM G) GROUP BY ALL) SELECT src, dst, pos FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(distance, 9), dst) AS pos FROM M) WHERE pos <= 10")
def merge(spark, d):
    g = near_graph(spark, d).select("src", "dst", "distance")
    m = g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    pos = F.row_number().over(Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")).cast("long")
    return m.withColumn("pos", pos).where("pos <= 10").select("src", "dst", "pos")


@add("g7_dense_points", "WITH L AS (SELECT vec_id, unnest(range(vec_id % 6 + 1)) AS pos FROM embeddings) SELECT vec_id AS id, pos // 2 AS clone, count(*) AS labels FROM L GROUP BY ALL")
def dense(spark, d):
    x = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 6).cast("int"))).alias("pos"))
    return x.groupBy("id", F.floor(F.col("pos") / 2).alias("clone")).agg(F.count("*").alias("labels"))


@add("s21_v27_manifest")
def fingerprints(spark, d):
    e = load(spark, d, "embeddings")
    return manifest(e, "embeddings").unionByName(manifest(load(spark, d, "labels"), "labels"))


@add("t7_windowed_changes", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(spark, d):
    return load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
