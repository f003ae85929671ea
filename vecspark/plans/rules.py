"""Rules of search and merging over traces: admission, skipping, expansion, pair gates, evaluation, small codecs.

A trace is the near graph read as visits: query src sees node dst at hop pos, with its distance. Cells are runs of 16
ids, communities are labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark import sources
from vecspark.functions import budgets
from vecspark.functions import vectors as V
from vecspark.operators import relational as R
from vecspark.operators import search as S
from vecspark.operators.lineage import cut, shared_folder

from .common import DOT, E_SQL, G_SQL, GM_SQL, L2, base, kept, load, near_graph, query_set, r6, registrar, vec_sql, vec_text
from .graphs import EV, W_SQL, cross, graph, importance, members

REGISTRY, add = registrar()
TR = G_SQL + ", TR AS (SELECT src AS query_id, pos AS hop, dst AS node_id, round(G.distance, 9) AS distance, E.label AS community, dst // 16 AS cell FROM G JOIN E ON dst = id)"
CELLS = "CC AS (SELECT cell, list(m ORDER BY i) AS centroid FROM (SELECT cell, i, avg(x) AS m FROM (SELECT id // 16 AS cell, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM E) GROUP BY cell, i) GROUP BY cell)"


def trace(spark, d):
    t = near_graph(spark, d).select(F.col("src").alias("query_id"), F.col("pos").alias("hop"), F.col("dst").alias("node_id"), F.round("distance", 9).alias("distance"))
    return t.join(members(spark, d).withColumnRenamed("id", "node_id"), "node_id").withColumn("cell", F.floor(F.col("node_id") / 16))


def cells(spark, d):
    """(id, vec, cell) of the vectors."""
    return base(spark, d).withColumn("cell", F.floor(F.col("id") / 16))


def batches(spark, d):
    """(query_id, cell, support, evidence, competitive, threshold): what a query saw of each cell.

    The threshold is the distance of its fourth node; competitive nodes are at most as far.
    """
    t = trace(spark, d)
    fourth = t.where("hop = 4").select("query_id", F.col("distance").alias("threshold"))
    near = F.sum((F.col("distance") <= F.col("threshold")).cast("long"))
    return t.join(fourth, "query_id", "left").groupBy("query_id", "cell").agg(F.count("*").alias("support"), F.min("distance").alias("evidence"), F.coalesce(near, F.lit(0)).alias("competitive"), F.max("threshold").alias("threshold"))


BATCH = TR + ", TH AS (SELECT query_id, distance AS threshold FROM TR WHERE hop = 4), BT AS (SELECT TR.query_id, cell, count(*) AS support, min(distance) AS evidence, coalesce(sum((distance <= threshold)::INT), 0)::BIGINT AS competitive, max(threshold) AS threshold FROM TR LEFT JOIN TH ON TR.query_id = TH.query_id GROUP BY TR.query_id, cell)"


@add("f7_m12_batch_admission", f"WITH {BATCH} SELECT query_id, cell, CASE WHEN threshold IS NOT NULL AND evidence > threshold * 1.1 THEN 'evidence' WHEN competitive < 1 OR competitive * 1.0 / support < 0.5 OR (threshold IS NOT NULL AND evidence > threshold * 1.05) THEN 'low_yield' ELSE 'admitted' END AS verdict FROM BT")
def batch_admission(spark, d):
    """A cell's batch is admitted by its evidence, then by the number and share of competitive nodes and its best one."""
    b = batches(spark, d)
    return b.select("query_id", "cell", V.batch_verdict(F.col("evidence"), F.col("threshold"), F.col("competitive"), F.col("support"), 1.1, 1.05, 1, 0.5).alias("verdict"))


@add("f8_graph_guard", "SELECT l AS search_l, f AS fraction, u AS unexpanded, u < l - least(l, ceil(f * l)) AS allowed FROM (SELECT unnest([0, 10, 40, 100]) AS l), (SELECT unnest([0.0::DOUBLE, 0.25, 0.9, 1.5]) AS f), (SELECT unnest([0, 4, 29, 30, 75]) AS u)")
def guard(spark, d):
    rows = [(n, f, u, budgets.guard_allows(n, f, u)) for n in (0, 10, 40, 100) for f in (0.0, 0.25, 0.9, 1.5) for u in (0, 4, 29, 30, 75)]
    return spark.createDataFrame(rows, "search_l int, fraction double, unexpanded int, allowed boolean")


@add("f9_m9_next_cell", f"WITH {BATCH}, M AS (SELECT * FROM BT WHERE support >= 2 AND (threshold IS NULL OR evidence <= threshold * 1.2) AND cell <> query_id // 16) SELECT query_id, cell, support FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, evidence, cell) AS r FROM M) WHERE r = 1")
def next_cell(spark, d):
    """The cell a query expands next: of its mature ones that aren't loaded, the best supported, then the nearest."""
    b = batches(spark, d).where(V.is_mature(F.col("support"), F.col("evidence"), F.col("threshold"), 2, 1.2)).where(F.col("cell") != F.floor(F.col("query_id") / 16))
    return b.groupBy("query_id").agg(F.min(F.struct((-F.col("support")).alias("s"), "evidence", "cell")).alias("m")).select("query_id", "m.cell", (-F.col("m.s")).alias("support"))


ROUTED = TR + f", {CELLS}, RC AS (SELECT q.id AS query_id, cell, {L2.format(a='q.vec', b='centroid')} AS distance FROM E q, CC WHERE q.id % 20 = 0)"


def routed(spark, d):
    """(query_id, cell, distance): of the query set the 64 nearest cells, by centroids."""
    c = R.centroid(cells(spark, d), "cell").select(F.col("cell").alias("id"), F.col("centroid").alias("vec"))
    found = S.exact_topk(query_set(base(spark, d)), c, 64)
    return found.select(F.col("qid").alias("query_id"), F.col("id").alias("cell"), "distance")


@add("m6_gateway_landing", f"WITH {ROUTED}, H AS (SELECT query_id, community FROM TR WHERE hop = 1), CM AS (SELECT DISTINCT id // 16 AS cell, label AS community FROM E), N AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), cell) AS near FROM RC) WHERE near <= 64), X AS (SELECT N.*, row_number() OVER (PARTITION BY N.query_id ORDER BY round(distance, 9), N.cell) AS r FROM N JOIN H ON N.query_id = H.query_id JOIN CM ON CM.cell = N.cell AND CM.community = H.community WHERE NOT EXISTS (SELECT 1 FROM TR WHERE TR.query_id = N.query_id AND TR.cell = N.cell)) SELECT query_id, cell FROM X WHERE r = 1")
def landing(spark, d):
    """Landing at its first node, a query adds the nearest cell with nodes of that community that it hasn't seen."""
    t = trace(spark, d)
    own = t.where("hop = 1").select("query_id", "community")
    held = cells(spark, d).select("cell", F.col("label").alias("community")).distinct()
    fresh = routed(spark, d).join(own, "query_id").join(held, ["cell", "community"]).join(t.select("query_id", "cell").distinct(), ["query_id", "cell"], "left_anti")
    return fresh.groupBy("query_id").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "cell"))["cell"].alias("cell"))


@add("m10_terminal_cells", f"WITH {ROUTED}, A AS (SELECT query_id, cell, 0 AS src, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, best, cell) AS r FROM (SELECT query_id, cell, count(*) AS n, min(distance) AS best FROM TR WHERE query_id % 20 = 0 GROUP BY ALL)), B AS (SELECT query_id, cell, 1 AS src, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), cell) AS r FROM RC), U AS (SELECT * FROM A WHERE r <= 3 UNION ALL SELECT * FROM B WHERE r <= 6), O AS (SELECT query_id, cell, min(src) AS src, min(src * 100 + r) AS k FROM U GROUP BY query_id, cell) SELECT query_id, cell, src, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM O) WHERE rank <= 5")
def terminal_cells(spark, d):
    """At the end three cells of the frontier, then routed ones that aren't among them, five in all."""
    t = trace(spark, d).where("query_id % 20 = 0").groupBy("query_id", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("best"))
    w = Window.partitionBy("query_id")
    a = t.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "best", "cell"))).where("r <= 3").select("query_id", "cell", F.lit(0).alias("src"), "r")
    b = routed(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.round("distance", 9), "cell"))).where("r <= 6").select("query_id", "cell", F.lit(1).alias("src"), "r")
    o = a.unionByName(b).groupBy("query_id", "cell").agg(F.min("src").alias("src"), F.min(F.col("src") * 100 + F.col("r")).alias("k"))
    return o.withColumn("rank", F.row_number().over(w.orderBy("k")).cast("long")).where("rank <= 5").select("query_id", "cell", "src", "rank")


@add("m20_stitch_promotion", f"WITH {TR}, S AS (SELECT query_id, cell, count(*) AS support, min(distance) AS best FROM TR WHERE cell <> query_id // 16 GROUP BY ALL), PM AS (SELECT query_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, best, cell) AS r FROM S WHERE support >= 2) WHERE r <= 2) SELECT TR.query_id, node_id, PM.cell IS NOT NULL AS promoted FROM TR LEFT JOIN PM ON TR.query_id = PM.query_id AND TR.cell = PM.cell WHERE TR.cell <> TR.query_id // 16")
def stitch(spark, d):
    """Results outside the admitted cell promote whole cells of two or more of them, up to two; others are refined singly."""
    t = trace(spark, d).where(F.col("cell") != F.floor(F.col("query_id") / 16))
    s = t.groupBy("query_id", "cell").agg(F.count("*").alias("support"), F.min("distance").alias("best")).where("support >= 2")
    p = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("support"), "best", "cell"))).where("r <= 2").select("query_id", "cell", F.lit(True).alias("p"))
    return t.join(p, ["query_id", "cell"], "left").select("query_id", "node_id", F.col("p").isNotNull().alias("promoted"))


CROSS = "X AS (SELECT s.label AS source_community, t.label AS target_community, dst AS target_node, src FROM G JOIN E s ON src = s.id JOIN E t ON dst = t.id WHERE s.label <> t.label)"


@add("m4_community_skip", f"WITH {EV}, {CROSS}, SE AS (SELECT source_community, target_community, count(*) AS n FROM X GROUP BY ALL), BE AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_community ORDER BY n DESC, target_community) AS k FROM SE) WHERE k <= 2), T AS (SELECT source_community, target_community, target_node, min(src) AS source_node FROM X GROUP BY ALL), GW AS (SELECT T.*, row_number() OVER (PARTITION BY T.source_community, T.target_community ORDER BY round(raw, 9) DESC, target_node) AS o FROM T JOIN R ON target_node = R.id) SELECT source_community, hop, target_community, source_node, target_node FROM (SELECT GW.*, row_number() OVER (PARTITION BY GW.source_community ORDER BY k, o) AS hop FROM GW JOIN BE ON GW.source_community = BE.source_community AND GW.target_community = BE.target_community WHERE o <= 4) WHERE hop <= 6")
def community_skip(spark, d):
    """From each community the two strongest superedges in turn, up to four gateways each, six targets in all."""
    x = cut(cross(spark, d))
    w = Window.partitionBy("source_community")
    edges = x.groupBy("source_community", "target_community").agg(F.count("*").alias("n"))
    best = edges.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "target_community"))).where("k <= 2")
    g = R.gateways(x, importance(spark, d).select("id", F.round("raw", 9).alias("importance")), 4).join(best, ["source_community", "target_community"])
    return g.withColumn("hop", F.row_number().over(w.orderBy("k", "ordinal")).cast("long")).where("hop <= 6").select("source_community", "hop", "target_community", "source_node", "target_node")


PAIR = f"M AS (SELECT id, id // 16 AS cell, id // 32 AS parent, vec FROM E), CG AS (SELECT cell, list(m ORDER BY i) AS c FROM (SELECT cell, i, avg(x) AS m FROM (SELECT cell, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM M) GROUP BY cell, i) GROUP BY cell), PG AS (SELECT parent, list(m ORDER BY i) AS c FROM (SELECT parent, i, avg(x) AS m FROM (SELECT parent, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM M) GROUP BY parent, i) GROUP BY parent), D AS (SELECT id, M.cell, M.parent, {L2.format(a='vec', b='CG.c')} AS d, {L2.format(a='vec', b='PG.c')} AS pd FROM M JOIN CG ON M.cell = CG.cell JOIN PG ON M.parent = PG.parent), DR AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d) AS r, count(*) OVER (PARTITION BY cell) AS n, row_number() OVER (PARTITION BY parent ORDER BY pd) AS pr, count(*) OVER (PARTITION BY parent) AS pn FROM D), GC AS (SELECT cell, any_value(parent) AS parent, count(*) AS n, sqrt(avg(d)) AS rms, sqrt(max(d) FILTER (r = ceil(0.95 * n))) AS p95, sum(d) AS sse FROM DR GROUP BY cell), GP AS (SELECT parent, count(*) AS population, sqrt(avg(pd)) AS rms, sqrt(max(pd) FILTER (pr = ceil(0.95 * pn))) AS p95, sum(pd) AS sse FROM DR GROUP BY parent), PR AS (SELECT GP.*, x.cell AS a, y.cell AS b, CASE WHEN GP.sse = 0 THEN 0 ELSE (GP.sse - x.sse - y.sse) / GP.sse END AS split_gain, CASE WHEN x.p95 + y.p95 = 0 THEN 1 ELSE greatest(0, least(1, (x.p95 + y.p95 - sqrt({L2.format(a='xc.c', b='yc.c')})) / (x.p95 + y.p95))) END AS overlap, CASE WHEN population <= 16 THEN 16 ELSE 32 END AS capacity FROM GP JOIN GC x ON x.cell = GP.parent * 2 JOIN GC y ON y.cell = GP.parent * 2 + 1 JOIN CG xc ON xc.cell = x.cell JOIN CG yc ON yc.cell = y.cell), NM AS (SELECT PR.*, rms / greatest(median(rms) OVER (PARTITION BY capacity), 1e-12) AS normalized_rms, p95 / greatest(median(p95) OVER (PARTITION BY capacity), 1e-12) AS normalized_p95 FROM PR)"


def geometry(df, key):
    """(key, n, rms, p95, sse, centroid): root mean square and nearest-rank p95 distance to the centroid, and their sum."""
    x = df.join(R.centroid(df, key).select(key, "centroid"), key).withColumn("d", V.l2(F.col("vec"), F.col("centroid")))
    w = Window.partitionBy(key)
    x = x.withColumn("r", F.row_number().over(w.orderBy("d"))).withColumn("m", F.count("*").over(w))
    p95 = F.sqrt(F.max(F.when(F.col("r") == F.ceil(F.lit(0.95) * F.col("m")), F.col("d"))))
    return x.groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.avg("d")).alias("rms"), p95.alias("p95"), F.sum("d").alias("sse")).join(R.centroid(df, key).select(key, "centroid"), key)


def sibling_pairs(spark, d):
    """Geometry of pairs of neighbouring cells as one, and how it compares with the cohort of their capacity."""
    c = cells(spark, d).withColumn("parent", F.floor(F.col("cell") / 2))
    own, both = cut(geometry(c, "cell")), geometry(c, "parent")
    side = lambda p, at: own.select(F.floor(F.col("cell") / 2).alias("parent"), *(F.col(x).alias(f"{p}_{x}") for x in ("cell", "p95", "sse", "centroid"))).where(F.col(f"{p}_cell") % 2 == at)
    x = both.join(side("x", 0), "parent").join(side("y", 1), "parent")
    reach = F.col("x_p95") + F.col("y_p95")
    apart = F.sqrt(V.l2(F.col("x_centroid"), F.col("y_centroid")))
    gain = F.when(F.col("sse") == 0, 0.0).otherwise((F.col("sse") - F.col("x_sse") - F.col("y_sse")) / F.col("sse"))
    overlap = F.when(reach == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (reach - apart) / reach)))
    x = cut(x.select("parent", F.col("x_cell").alias("a"), F.col("y_cell").alias("b"), F.col("n").alias("population"), "rms", "p95", gain.alias("split_gain"), overlap.alias("overlap"), V.capacity_class(F.col("n")).alias("capacity")))
    middle = x.groupBy("capacity").agg(F.median("rms").alias("mr"), F.median("p95").alias("mp"))
    least = lambda m: F.greatest(F.col(m), F.lit(1e-12))
    return x.join(middle, "capacity").withColumn("normalized_rms", F.col("rms") / least("mr")).withColumn("normalized_p95", F.col("p95") / least("mp"))


@add("a31_a32_pair_geometry", f"WITH {E_SQL}, {PAIR} SELECT a, b, population, round(rms, 6) AS rms, round(p95, 6) AS p95, round(split_gain, 6) AS split_gain, round(overlap, 6) AS overlap, round(normalized_rms, 6) AS normalized_rms, round(normalized_p95, 6) AS normalized_p95 FROM NM")
def pair_geometry(spark, d):
    return sibling_pairs(spark, d).select("a", "b", "population", *(r6(c) for c in ("rms", "p95", "split_gain", "overlap", "normalized_rms", "normalized_p95")))


REPLAY = "TC AS (SELECT DISTINCT query_id, cell FROM TR), JN AS (SELECT x.cell AS a, y.cell AS b, count(*) AS joint FROM TC x JOIN TC y ON x.query_id = y.query_id AND y.cell = x.cell + 1 WHERE x.cell % 2 = 0 GROUP BY ALL), VC AS (SELECT cell, count(DISTINCT query_id) AS v, count(*) AS hits FROM TR GROUP BY cell), RP AS (SELECT x.cell AS a, y.cell AS b, coalesce(joint, 0) AS joint, x.v + y.v AS fixed, x.v + y.v - coalesce(joint, 0) AS merged, x.hits + y.hits AS hits FROM VC x JOIN VC y ON y.cell = x.cell + 1 AND x.cell % 2 = 0 LEFT JOIN JN ON JN.a = x.cell)"


def replay(spark, d):
    """(a, b, joint, fixed, merged, hits): queries that touch both cells of a pair, touches of each, of either, and nodes."""
    t = trace(spark, d)
    c = t.select("query_id", "cell").distinct()
    j = c.where("cell % 2 = 0").join(c.select("query_id", (F.col("cell") - 1).alias("cell"), F.lit(1).alias("o")), ["query_id", "cell"]).groupBy(F.col("cell").alias("a")).agg(F.count("*").alias("joint"))
    v = t.groupBy("cell").agg(F.countDistinct("query_id").alias("v"), F.count("*").alias("hits"))
    x = v.where("cell % 2 = 0").select(F.col("cell").alias("a"), F.col("v").alias("va"), F.col("hits").alias("ha")).join(v.select((F.col("cell") - 1).alias("a"), F.col("cell").alias("b"), "v", "hits"), "a").join(j, "a", "left").na.fill(0, ["joint"])
    return x.select("a", "b", "joint", (F.col("va") + F.col("v")).alias("fixed"), (F.col("va") + F.col("v") - F.col("joint")).alias("merged"), (F.col("ha") + F.col("hits")).alias("hits"))


@add("f11_pair_gate", f"WITH {TR}, {PAIR}, {REPLAY} SELECT NM.a, NM.b, CASE WHEN joint < 3 THEN 'train_pair_support' WHEN NOT (normalized_rms <= 1.05 OR normalized_p95 <= 1.0) THEN 'compact_region' WHEN NOT (split_gain <= 0.05 OR overlap >= 0.3) THEN 'weak_split' WHEN joint * 1.0 / merged < 0.05 THEN 'train_cross_child_coaccess' WHEN NOT (2 * merged - fixed <= fixed * 0.9 AND merged < fixed) THEN 'page_economics' WHEN (32.0 * merged - hits) / greatest(16.0 * fixed - hits, 1) - 1 > 0.85 THEN 'scoring_overhead' ELSE '' END AS rejection FROM NM JOIN RP ON NM.a = RP.a")
def pair_gate(spark, d):
    """The first of six checks that a pair of cells fails: support, compactness, split, co-access, pages, scoring."""
    x = sibling_pairs(spark, d).join(replay(spark, d).drop("b"), "a")
    pages = (2 * F.col("merged") - F.col("fixed") <= F.col("fixed") * 0.9) & (F.col("merged") < F.col("fixed"))
    unseen = (32.0 * F.col("merged") - F.col("hits")) / F.greatest(16.0 * F.col("fixed") - F.col("hits"), F.lit(1)) - 1
    compact = (F.col("normalized_rms") <= 1.05) | (F.col("normalized_p95") <= 1.0)
    checks = [("train_pair_support", F.col("joint") >= 3), ("compact_region", compact), ("weak_split", (F.col("split_gain") <= 0.05) | (F.col("overlap") >= 0.3)), ("train_cross_child_coaccess", F.col("joint") / F.col("merged") >= 0.05), ("page_economics", pages), ("scoring_overhead", unseen <= 0.85)]
    return x.select("a", "b", V.first_failure(checks).alias("rejection"))


@add("f10_a34_merge_profile", f"WITH {TR}, {REPLAY} SELECT a, b, joint, round(joint * 1.0::DOUBLE / merged, 6) AS coaccess, round(2.0::DOUBLE * merged / fixed - 1, 6) AS page_increase, joint >= 3 AND joint * 1.0 / merged >= 0.9 AND 2.0 * merged / fixed - 1 <= 0.1 AS eligible FROM RP")
def merge_profile(spark, d):
    """Co-access and the change of pages read if two cells were one, and whether they may merge."""
    x = replay(spark, d).withColumn("coaccess", F.col("joint") / F.col("merged")).withColumn("page_increase", V.relative_increase(2 * F.col("merged"), F.col("fixed")))
    return x.select("a", "b", "joint", r6("coaccess"), r6("page_increase"), ((F.col("joint") >= 3) & (F.col("coaccess") >= 0.9) & (F.col("page_increase") <= 0.1)).alias("eligible"))


@add("w13_disjoint_pairs")
def disjoint_pairs(spark, d):
    """Of pairs of cells the best co-accessed ones, none sharing a cell."""
    c = trace(spark, d).select("query_id", "cell").distinct()
    j = c.alias("x").join(c.alias("y"), (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.cell") < F.col("y.cell")) & (F.col("y.cell") <= F.col("x.cell") + 4)).groupBy(F.col("x.cell").alias("a"), F.col("y.cell").alias("b")).agg(F.count("*").alias("together"))
    return R.disjoint_pairs(j, "together")


@add("a17_active_recall", f"WITH {E_SQL}, O AS (SELECT q.id AS qid, b.id, round({L2.format(a='b.vec', b='q.vec')}, 9) AS d, b.id % 5 <> 2 AS live FROM E b, E q WHERE q.id % 20 = 0), N AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r, sum(live::INT) OVER (PARTITION BY qid ORDER BY d, id) AS lives FROM O), T AS (SELECT * FROM N WHERE r <= 30), B AS (SELECT qid, max(d) AS bound FROM T WHERE lives < 10 OR (lives = 10 AND live) GROUP BY qid), F AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS k FROM O WHERE live AND id % 3 <> 0) WHERE k <= 10) SELECT T.qid, count(F.id) * 10.0::DOUBLE AS recall FROM T JOIN B ON T.qid = B.qid LEFT JOIN F ON F.qid = T.qid AND F.id = T.id WHERE d <= bound GROUP BY T.qid")
def active_recall(spark, d):
    """Recall where only live rows count: the truth goes as far as ten of them, and ties with the last."""
    e = base(spark, d)
    q, live = query_set(e), F.col("id") % 5 != 2
    truth = S.exact_topk(q, e, 30).withColumn("distance", F.round("distance", 9))
    found = S.exact_topk(q, e.where(live & (F.col("id") % 3 != 0)), 10)
    return R.recall_of_active(found, truth, e.where(live).select("id"), 10)


@add("a17_range_recall", f"WITH {E_SQL}, O AS (SELECT q.id AS qid, b.id, {L2.format(a='b.vec', b='q.vec')} AS d FROM E b, E q WHERE q.id % 20 = 0) SELECT qid, round(CASE WHEN count(*) FILTER (d <= 1.6) = 0 THEN 100 ELSE 100.0 * count(*) FILTER (d <= 1.6 AND id % 4 <> 1) / count(*) FILTER (d <= 1.6) END, 6)::DOUBLE AS recall FROM O GROUP BY qid")
def range_recall(spark, d):
    e = base(spark, d)
    truth = S.range_search(query_set(e), e, 1.6)
    return R.range_recall(query_set(e).select("qid"), truth, truth.where("id % 4 <> 1")).select("qid", r6("recall"))


@add("a21_community_edges", f"WITH {G_SQL}, J AS (SELECT s.label AS a, t.label AS b FROM G JOIN E s ON src = s.id JOIN E t ON dst = t.id) SELECT c AS community, sum(i)::BIGINT AS internal_edges, sum(n)::BIGINT AS incoming_edges, sum(o)::BIGINT AS outgoing_edges FROM (SELECT a AS c, (a = b)::INT AS i, 0 AS n, (a <> b)::INT AS o FROM J UNION ALL SELECT b, 0, (a <> b)::INT, 0 FROM J) GROUP BY c")
def community_edges(spark, d):
    return R.community_edges(graph(spark, d), members(spark, d))


@add("a26_modularity_gain", f"WITH {W_SQL}, B AS (SELECT a AS u, b AS v, weight FROM U UNION ALL SELECT b, a, weight FROM U), K AS (SELECT u, sum(weight) AS k FROM B GROUP BY u), T AS (SELECT label, sum(k) AS t, count(*) AS size FROM K JOIN E ON u = id GROUP BY label), W AS (SELECT u, label, sum(weight) AS w FROM B JOIN E ON v = id GROUP BY ALL), M AS (SELECT sum(weight)::DOUBLE / 2 AS m FROM B) SELECT W.u AS id, W.label AS target, k::BIGINT AS degree, round((w - coalesce(o.w0, 0))::DOUBLE / m - k::DOUBLE * (k + T.t - S.t) / (2 * m * m), 12) AS gain FROM W JOIN E ON W.u = E.id JOIN K ON K.u = W.u JOIN T ON T.label = W.label JOIN T S ON S.label = E.label LEFT JOIN (SELECT u AS ou, label AS ol, w AS w0 FROM W) o ON ou = W.u AND ol = E.label, M WHERE W.label <> E.label")
def modularity_gain(spark, d):
    """What modularity gains if a node moves to another community around it, and its weighted degree."""
    return R.modularity_gains(R.undirected_weights(graph(spark, d)), members(spark, d)).select("id", "target", "degree", F.round("gain", 12).alias("gain"))


@add("w2_importance_mass", f"WITH {EV}, NR AS (SELECT id, round(raw, 9) AS m FROM R), CU AS (SELECT id, m, sum(m) OVER (ORDER BY m DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(m) OVER () AS total FROM NR) SELECT id FROM CU WHERE total > 0 AND coalesce(before, 0) < 0.3 * total")
def importance_mass(spark, d):
    """The most important nodes up to the smallest number that holds 0.3 of the importance."""
    return R.importance_mass(importance(spark, d).select("id", F.round("raw", 9).alias("mass")), 0.3).select("id")


@add("f2_raw_labels", "SELECT r AS raw, CASE WHEN r = '' THEN NULL ELSE coalesce((SELECT min(k) FROM (SELECT source, dense_rank() OVER (ORDER BY source) AS k FROM documents) WHERE source = r), 0) END AS label FROM (SELECT unnest(['src0', 'src7', 'nowhere', '']) AS r) WHERE r <> '' ")
def raw_labels(spark, d):
    """Raw labels by a dictionary; unknown ones become the universal label 0."""
    names = load(spark, d, "documents").select("source").where("source is not null").distinct()
    asked = spark.createDataFrame([("src0",), ("src7",), ("nowhere",)], "raw string")
    return R.label_ids(asked, R.numbered(names, "source", "label").select(F.col("source").alias("raw"), (F.col("label") + 1).alias("label")), universal=0)


@add("f5_unvisited_topk", f"WITH {E_SQL}, D AS (SELECT q.id AS qid, b.id, {L2.format(a='b.vec', b='q.vec')} AS distance FROM E b, E q WHERE q.id % 20 = 0 AND b.id % 7 <> q.id % 7) SELECT qid, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM D) WHERE rank <= 3")
def unvisited(spark, d):
    """The nearest rows a query hasn't visited: those of its own remainder by 7 are. More are fetched until three are left."""
    e = base(spark, d)
    q = query_set(e)
    seen = e.select("id").join(q.select("qid"), F.col("id") % 7 == F.col("qid") % 7)
    return R.excluding(lambda k: S.exact_topk(q, e, k), seen, 3).select("qid", "rank", "id", r6("distance"))


@add("u5_exact_over_approximate", f"WITH {TR} SELECT query_id AS qid, node_id AS id, CASE WHEN node_id % 2 = 0 THEN round(distance, 6) ELSE round(distance, 1) END AS distance FROM TR")
def merged(spark, d):
    """Approximate results, with the exact distances where they are known."""
    t = trace(spark, d).select(F.col("query_id").alias("qid"), F.col("node_id").alias("id"), "distance")
    return R.exact_over(t.where("id % 2 = 0"), t.withColumn("distance", F.round("distance", 1))).select("qid", "id", r6("distance"))


@add("u7_split_guard", "SELECT CASE WHEN user_id % 4 = 0 THEN 'heldout' ELSE 'train' END AS split, count(DISTINCT user_id) AS queries, 0::BIGINT AS shared FROM events GROUP BY ALL")
def splits(spark, d):
    """Queries of each split; a query in two splits is an error."""
    t = load(spark, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("user_id") % 4 == 0, "heldout").otherwise("train").alias("split"))
    return R.require_disjoint(t, "query_id", "split").groupBy("split").agg(F.countDistinct("query_id").alias("queries")).withColumn("shared", F.lit(0).cast("long"))


@add("a38_oracle_hits", f"WITH {TR}, C AS (SELECT query_id, cell, count(*) AS n, min(distance) AS best FROM TR GROUP BY ALL), K AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, best, cell) AS r FROM C) SELECT query_id, count(*) AS cells, (sum(n) FILTER (r <= 1))::BIGINT AS top1, (sum(n) FILTER (r <= 2))::BIGINT AS top2, (sum(n) FILTER (r <= 4))::BIGINT AS top4, arg_min(cell, r) AS best_cell FROM K GROUP BY query_id")
def oracle_hits(spark, d):
    """Of each query's nodes those in its best 1, 2 and 4 cells, its cells, and the best one."""
    c = trace(spark, d).groupBy("query_id", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("best"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "best", "cell")))
    return c.groupBy("query_id").agg(F.count("*").alias("cells"), *(F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)).alias(f"top{k}") for k in (1, 2, 4)), F.min_by("cell", "r").alias("best_cell"))


@add("v21_angles", f"WITH {E_SQL} SELECT b.id, round(acos(least(1, greatest(-1, {DOT.format(a='b.vec', b='q.vec')}))), 4) AS angle FROM E b JOIN E q ON q.id = b.id - b.id % 20 WHERE b.id % 20 <> 0")
def angles(spark, d):
    e = base(spark, d)
    x = e.join(query_set(e), F.col("qid") == F.col("id") - F.col("id") % 20).where("id % 20 <> 0")
    return x.select("id", F.round(V.angle(F.col("vec"), F.col("qvec")), 4).alias("angle"))


MIX = ", ".join(f"{a} AS (SELECT *, {b} AS {c} FROM {t})" for a, t, c, b in (
    ("M1", "M0", "a", "((id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"),
    ("M2", "M1", "b", "((xor(a, a >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"),
    ("M3", "M2", "c", "((xor(b, b >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"),
    ("M4", "M3", "mixed", "xor(c, c >> 31)"),
))


@add("v22_j17_memgraph_nodes", f"WITH M0 AS (SELECT vec_id AS id FROM embeddings), {MIX} SELECT id, mixed::VARCHAR AS mixed, rank FROM (SELECT *, row_number() OVER (ORDER BY mixed, id) AS rank FROM M4) WHERE rank <= 64")
def memgraph_nodes(spark, d):
    """The 64 ids with the smallest mixed values, a random sample that any partitioning repeats."""
    return R.least_mixed(base(spark, d).select("id"), 64)


@add("j17_important_nodes", f"WITH {G_SQL}, I AS (SELECT dst AS id, count(*) AS n FROM G GROUP BY dst), HD AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS r FROM I), CI AS (SELECT E.id, row_number() OVER (PARTITION BY label ORDER BY coalesce(n, 0) DESC, E.id) AS r FROM E LEFT JOIN I ON E.id = I.id), A AS (SELECT id, 0 AS p, r FROM CI WHERE r <= 2 UNION ALL SELECT id, 1, r FROM HD WHERE r <= 30) SELECT id, min(p) AS priority FROM A GROUP BY id")
def important_nodes(spark, d):
    """Two nodes of the highest in-degree a community, then 30 of all, each once under its first reason."""
    i = graph(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    own = members(spark, d).join(i, "id", "left").na.fill(0, ["n"])
    a = own.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "id"))).where("r <= 2").select("id", F.lit(0).alias("priority"))
    b = i.orderBy(F.desc("n"), "id").limit(30).select("id", F.lit(1).alias("priority"))
    return a.unionByName(b).groupBy("id").agg(F.min("priority").alias("priority"))


@add("v23_chunk_ids", "SELECT vec_id AS id, (vec_id % 4) * 4611686018427387904::UHUGEINT + vec_id::UHUGEINT AS c, (vec_id % 4)::INT AS type, vec_id AS number, vec_id * [4096, 65536, 524288, 2097152][vec_id % 4 + 1] AS \"offset\" FROM embeddings".replace("(vec_id % 4) * 4611686018427387904::UHUGEINT + vec_id::UHUGEINT AS c, ", ""))
def chunk_ids(spark, d):
    """Chunk types and numbers back from their packed form, and where a chunk lies."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    e = e.withColumn("chunk", V.chunk_id((F.col("id") % 4).cast("int"), F.col("id")))
    kind, number = V.chunk_parts(F.col("chunk"))
    return e.select("id", kind.alias("type"), number.alias("number"), (number * F.element_at(F.array(*map(F.lit, V.CHUNK_BYTES)), kind + 1)).alias("offset"))


@add("v24_v25_memory_plans", "SELECT n, dim, greatest(1, least(least(dim, 512), b // n))::BIGINT AS chunks, round(1.1 * (n * dim * 4.0 + n * 64 * 4.0 * 1.3), 1)::DOUBLE AS bytes FROM (SELECT unnest([1000, 1000000]) AS n), (SELECT unnest([64, 1024]) AS dim), (SELECT unnest([500000, 1000000000]) AS b)")
def memory_plans(spark, d):
    rows = [(n, dim, budgets.pq_chunks_for(b, n, dim), round(budgets.index_bytes(n, dim, 64), 1)) for n in (1000, 1_000_000) for dim in (64, 1024) for b in (500_000, 1_000_000_000)]
    return spark.createDataFrame(rows, "n int, dim int, chunks long, bytes double")


@add("g20_g21_hierarchy", f"WITH {E_SQL}, {CELLS}, L1 AS (SELECT id // 64 AS node, count(*) AS n FROM E GROUP BY ALL), C1 AS (SELECT node, list(m ORDER BY i) AS centroid FROM (SELECT node, i, avg(x) AS m FROM (SELECT id // 64 AS node, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM E) GROUP BY node, i) GROUP BY node) SELECT L1.node, n AS descendants, {vec_sql('C1.centroid')} AS centroid, round(sqrt((SELECT max({L2.format(a='vec', b='C1.centroid')}) FROM E WHERE id // 64 = L1.node)), 6) AS radius, true AS valid FROM L1 JOIN C1 ON L1.node = C1.node")
def hierarchy(spark, d):
    """Nodes over four cells each: descendants, their mean, the radius that holds them, and whether children agree."""
    e = cells(spark, d).withColumn("node", F.floor(F.col("cell") / 4))
    c = R.centroid(e, "cell").withColumn("node", F.floor(F.col("cell") / 4))
    mean = R.weighted_centroid(c, "node")
    x = e.join(mean.select("node", "centroid"), "node").withColumn("d", V.radius(F.col("vec"), F.col("centroid")))
    x = x.groupBy("node").agg(F.count("*").alias("descendants"), F.max("d").alias("radius")).join(mean.withColumnRenamed("n", "m"), "node")
    return x.select("node", "descendants", vec_text(F.col("centroid")).alias("centroid"), r6("radius"), (F.col("m") == F.col("descendants")).alias("valid"))




def files(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@add("s1_s2_s5_s6_vector_files", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, true AS same FROM embeddings WHERE vec_id % 20 = 0")
def vector_files(spark, d):
    """The query set written in both binary forms and read back: whether each row is the same."""
    q = query_set(base(spark, d)).select(F.col("qid").alias("id"), F.col("qvec").alias("vec"))
    p = files(spark)
    sources.save_bin(q, f"{p}/a.bin")
    sources.save_vecs(q, f"{p}/a.fvecs")
    a, b = sources.read_bin(spark, f"{p}/a.bin"), sources.read_vecs(spark, f"{p}/a.fvecs")
    want = R.numbered(q, "id", "at").select("at", F.col("vec").alias("w"))
    x = want.join(a.select(F.col("id").alias("at"), F.col("vec").alias("a")), "at", "full").join(b.select(F.col("id").alias("at"), F.col("vec").alias("b")), "at", "full")
    return x.select("at", (F.col("w").eqNullSafe(F.col("a")) & F.col("w").eqNullSafe(F.col("b"))).alias("same"))


@add("s7_s18_truth_files", f"WITH {E_SQL}, D AS (SELECT q.id // 20 AS qid, b.id, {L2.format(a='b.vec', b='q.vec')} AS distance FROM E b, E q WHERE q.id % 20 = 0) SELECT qid, rank, id, id AS result, round(distance::FLOAT::DOUBLE, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM D) WHERE rank <= 10")
def truth_files(spark, d):
    """Results written as a truth file and as a pair of result files, and read back."""
    e = base(spark, d)
    found = cut(S.exact_topk(query_set(e), e, 10))
    p = files(spark)
    sources.save_truth(found, f"{p}/truth.bin", 10)
    sources.save_results(found, f"{p}/out", 64)
    ids = sources.read_bin(spark, f"{p}/out_64_idx_uint32.bin", "uint32").select(F.col("id").alias("qid"), F.posexplode("vec").alias("r", "result"))
    back = sources.load_truth(spark, f"{p}/truth.bin").join(ids.select("qid", (F.col("r") + 1).cast("long").alias("rank"), F.col("result").cast("long").alias("result")), ["qid", "rank"])
    return back.select("qid", "rank", "id", "result", F.round("distance", 4).alias("distance"))


@add("s17_s23_s30_csv_tables", f"WITH {EV} SELECT E.id AS node_id, label AS community_id, E.id // 16 AS cell_id, round(raw, 9) AS raw_importance FROM E JOIN R ON E.id = R.id")
def csv_tables(spark, d):
    """Assignment of nodes to cells with their importance, through CSV files with a checked header."""
    i = importance(spark, d).select(F.col("id").alias("node_id"), F.round("raw", 9).alias("raw_importance"))
    t = cells(spark, d).select(F.col("id").alias("node_id"), F.col("label").alias("community_id"), F.col("cell").alias("cell_id")).join(i, "node_id")
    p = files(spark)
    sources.save_csv(t, p, ["node_id"])
    return sources.load_csv(spark, p, "node_id long, community_id long, cell_id long, raw_importance double")


@add("s27_tags", "SELECT vec_id AS id, vec_id * 3 + 1 AS tag FROM embeddings")
def tags(spark, d):
    e = base(spark, d).select("id")
    return sources.load_tags(e.select("id", (F.col("id") * 3 + 1).alias("tag")), e)


FNV = "list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::UBIGINT)), lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"


@add("v27_checksums", f"SELECT id, lpad(lower(to_hex({FNV})), 16, '0') AS fnv1a, sha256(t) AS sha256 FROM (SELECT event_id AS id, event_type || ':' || user_id::VARCHAR AS t FROM events)")
def checksums(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("t"))
    return sources.checksums(e, "t").select("id", "fnv1a", "sha256")


@add("s20_codebook_file", "SELECT true AS same, true AS damage_found")
def codebook_file(spark, d):
    """A codebook through its file, and the same file with one byte changed."""
    from .search import codebook

    book, p = codebook(spark, d), files(spark)
    sources.save_codebook(spark, f"{p}/book", book)
    same = bool((sources.load_codebook(spark, f"{p}/book") == book).all())
    data = bytearray(sources.read_file(spark, f"{p}/book"))
    data[100] ^= 1
    sources.write_file(spark, f"{p}/bad", bytes(data))
    try:
        sources.load_codebook(spark, f"{p}/bad")
        found = False
    except ValueError:
        found = True
    return spark.createDataFrame([(same, found)], "same boolean, damage_found boolean")


def gone(spark, d):
    return base(spark, d).where("id % 10 = 0").select("id")


def pruned(spark, d):
    """The graph pruned to five neighbours, ids divisible by 10 deleted; both outputs come from one written pass."""
    return kept(spark, d, "pruned", lambda: S.pruned(graph(spark, d), base(spark, d), 5, 1.2, gone(spark, d)))


#: Pruning step by step: a candidate passes at slack 1, then 1.2, if no passed nearer one occludes it.
PRUNE = GM_SQL + """, F AS (SELECT x.src, x.pos AS p, w.pos AS w, x.dst AS victim_id, w.dst AS witness_id, x.distance AS d_sv, b.distance AS d_wv, CASE WHEN b.distance = 0 THEN 'inf'::DOUBLE ELSE x.distance / b.distance END AS f
FROM G x JOIN G w ON x.src = w.src AND w.pos <> x.pos JOIN P b ON b.src = w.dst AND b.dst = x.dst),
M AS (SELECT src, list(fs ORDER BY p) AS m FROM (SELECT src, p, list(f ORDER BY w) AS fs FROM F WHERE w < p GROUP BY src, p) GROUP BY src),
DL AS (SELECT src, list(dst % 10 = 0 ORDER BY pos) AS gone, count(*) AS n FROM G GROUP BY src),
K(src, step, passed) AS (SELECT src, 0, []::BIGINT[] FROM DL UNION ALL
SELECT K.src, step + 1, CASE WHEN len(list_filter(passed, lambda k: NOT gone[k])) < 5 AND NOT list_contains(passed, step % n + 1) AND coalesce(list_max(list_transform(list_filter(passed, lambda k: k < step % n + 1), lambda k: m[step % n][k])), 0) <= CASE WHEN step < n THEN 1 ELSE 1.2 END THEN list_append(passed, step % n + 1) ELSE passed END
FROM K JOIN DL ON K.src = DL.src LEFT JOIN M ON M.src = K.src WHERE step < 2 * n),
O AS (SELECT K.src, passed, gone FROM K JOIN DL ON K.src = DL.src WHERE step = 2 * n)"""


@add("g4_f6_pruned_graph", f"WITH RECURSIVE {PRUNE} SELECT G.src, dst FROM G JOIN O ON G.src = O.src WHERE list_contains(passed, pos) AND dst % 10 <> 0")
def pruned_graph(spark, d):
    """A graph pruned to a smaller degree: deleted rows occlude others and are no neighbours."""
    return pruned(spark, d).select("src", F.explode("neighbours").alias("dst"))


@add("g5_a13_prune_events", f"WITH RECURSIVE {PRUNE}, W AS (SELECT * FROM (SELECT F.*, row_number() OVER (PARTITION BY F.src, p ORDER BY f DESC, witness_id) AS r FROM F JOIN O ON F.src = O.src WHERE w < p AND list_contains(passed, w) AND NOT list_contains(passed, p) AND victim_id % 10 <> 0) WHERE r = 1 AND f > 1.2), A AS (SELECT W.src, W.p, min(F.d_wv) AS d_av FROM W JOIN F ON F.src = W.src AND F.p = W.p AND F.w <> W.w JOIN O ON O.src = W.src WHERE list_contains(passed, F.w) AND F.witness_id % 10 <> 0 GROUP BY ALL), R AS (SELECT W.*, sqrt(d_wv / d_sv) AS rw, coalesce(least(1, greatest(sqrt(d_av / d_sv), sqrt(d_wv / d_sv))), 1) AS rc FROM W LEFT JOIN A ON W.src = A.src AND W.p = A.p) SELECT src AS source_id, witness_id, victim_id, round(least(1, greatest(0, 1 - 0.5 * rw) * (CASE WHEN rw < rc THEN 1 - rw / rc ELSE 0 END)), 6) AS credit FROM R")
def prune_events(spark, d):
    """Which neighbour of a source made another one leave its list, and its credit against the next best."""
    e = pruned(spark, d).select(F.col("src").alias("source_id"), F.explode("events").alias("e")).select("source_id", "e.*")
    return e.select("source_id", "witness_id", "victim_id", F.round(V.event_credit(F.col("d_sv"), F.col("d_wv"), F.col("d_av"), 0.5, squared=True), 6).alias("credit"))


@add("g31_cached_nodes", f"WITH RECURSIVE {GM_SQL}, B(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT G.dst, B.level + 1 FROM B JOIN G ON G.src = B.id WHERE B.level < 32), L AS (SELECT id, min(level)::BIGINT AS level FROM B GROUP BY id) SELECT id, level FROM L ORDER BY level, id LIMIT (SELECT greatest(1, count(*) // 10) FROM E)")
def cached_nodes(spark, d):
    """The nodes nearest the entry by levels, a tenth of all: what a reader would keep in memory."""
    n = max(1, base(spark, d).count() // 10)
    return R.bfs_levels(cut(graph(spark, d).select("src", "dst")), spark.range(1)).orderBy("level", "id").limit(n)


@add("m14_beam_widths", "SELECT w AS width, e AS expanded, u AS useful, h AS hop, CASE WHEN h > 4 AND e > 0 AND 1 - u * 1.0 / e <= 0.25 THEN least(w + 1, 8) ELSE w END AS next FROM (SELECT unnest([1, 4, 8]) AS w), (SELECT unnest([0, 4, 8]) AS e), (SELECT unnest([0, 3, 4, 6, 8]) AS u), (SELECT unnest([0, 4, 5, 20]) AS h) WHERE u <= e")
def beams(spark, d):
    rows = [(w, e, u, h, budgets.next_beam(w, e, u, h, 4, 8, 0.25)) for w in (1, 4, 8) for e in (0, 4, 8) for u in (0, 3, 4, 6, 8) for h in (0, 4, 5, 20) if u <= e]
    return spark.createDataFrame(rows, "width int, expanded int, useful int, hop int, next int")


@add("m5_hub_ablation", f"WITH {EV}, H AS (SELECT * FROM (SELECT label, E.id, vec, row_number() OVER (PARTITION BY label ORDER BY round(raw, 9) DESC, E.id) AS r FROM E JOIN R ON E.id = R.id) WHERE r = 1), D AS (SELECT q.id AS query_id, H.id AS hub_id, round({L2.format(a='q.vec', b='H.vec')}, 9) AS distance FROM E q JOIN H ON q.label <> H.label WHERE q.id % 20 = 0), X AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, hub_id) AS rank FROM D) SELECT query_id, rank, hub_id FROM X WHERE rank <= 8")
def hub_ablation(spark, d):
    """Instead of gateways the hubs of all other communities, the nearest first, up to eight scores."""
    e, m = base(spark, d), members(spark, d)
    h = importance(spark, d).join(m, "id").groupBy("community").agg(F.min(F.struct((-F.round("raw", 9)).alias("m"), "id"))["id"].alias("id"))
    found = S.exact_topk(query_set(e), e.join(h, "id").select("id", "vec"), 9).select(F.col("qid").alias("query_id"), F.col("id").alias("hub_id"), F.round("distance", 9).alias("distance"))
    own = m.select(F.col("id").alias("query_id"), F.col("community").alias("own"))
    other = found.join(own, "query_id").join(h.select(F.col("id").alias("hub_id"), "community"), "hub_id").where("community <> own")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hub_id")).cast("long")
    return other.withColumn("rank", rank).where("rank <= 8").select("query_id", "rank", "hub_id")
