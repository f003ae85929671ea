"""Aggregations, rankings and set operations over vectors, graphs, cells and traces.

All are DataFrame in, DataFrame out and stay in the JVM, but for greedy choices in bounded groups. Edges are (src, pos, dst); traces are
(query_id, hop, node_id). Orders always end in an id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import vectors as V

from .lineage import cut


def running(df: DataFrame, order: str, amount: str, name: str, blocks: int | None = None) -> DataFrame:
    """df with the sum of amount as far as each row, in order of a column of distinct values.

    Rows are dealt into ranges of the order (as many as shuffle partitions), whose sums are added up first: no task
    sees all rows.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(df.repartitionByRange(blocks, order).withColumn("_block", F.spark_partition_id()))
    sums = ranges.groupBy("_block").agg(F.sum(amount).alias("s"))
    base = sums.withColumn("_base", F.sum("s").over(Window.orderBy("_block")) - F.col("s")).select("_block", "_base")  # at most `blocks` rows
    upto = F.sum(amount).over(Window.partitionBy("_block").orderBy(order))
    return ranges.withColumn(name, upto).join(F.broadcast(base), "_block").withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_base")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with dense numbers from 0 in order of a column of distinct values."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")


def centroid(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, n, centroid): element-wise means in double precision, partly summed before the shuffle."""
    parts = df.where(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("i", "x"))
    sums = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))


def medoid(df: DataFrame, key: str) -> DataFrame:
    """(key, id, distance): the row nearest its group's centroid; the smaller id on ties."""
    d = df.join(centroid(df, key), key).withColumn("distance", V.l2(F.col("vec"), F.col("centroid")))
    return d.groupBy(key).agg(F.min(F.struct("distance", "id")).alias("m")).select(key, F.col("m.id").alias("id"), F.col("m.distance").alias("distance"))


def nearest_centers(df: DataFrame, centers: DataFrame, k: int = 1) -> DataFrame:
    """(id, rank, center, distance) of the k nearest of a bounded table of centers (center, cvec)."""
    rows = centers.count()
    if rows > 1 << 16:
        raise ValueError("more centers than are broadcast: route through a hierarchy of them")
    packed = centers.agg(F.array_sort(F.collect_list(F.struct("center", "cvec"))).alias("cs"))
    near = F.slice(F.array_sort(F.transform("cs", lambda c: F.struct(V.l2(F.col("vec"), c["cvec"]).alias("distance"), c["center"].alias("center")))), 1, k)
    one = df.join(F.broadcast(packed)).select("id", F.posexplode(near).alias("i", "c"))
    return one.select("id", (F.col("i") + 1).cast("long").alias("rank"), F.col("c.center").alias("center"), F.col("c.distance").alias("distance"))


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): percent of the k; truth is extended by all ids as far as its k-th distance."""
    kth = truth.where(F.col("rank") == k).select("qid", F.col("distance").alias("bound"))
    wanted = truth.join(kth, "qid", "left").where(F.col("bound").isNull() | (F.col("distance") <= F.col("bound"))).select("qid", "id").distinct()
    hits = results.where(F.col("rank") <= k).join(wanted, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) * 100.0 / k).alias("recall"))


def floor_percentile(df: DataFrame, value: str, share: float, key: str | None = None) -> DataFrame:
    """The row min(floor(share * n), n - 1) of the sorted values, without interpolation.

    Values are counted before they are ordered, so one frequent value is one row.
    """
    by = [key] if key else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return run.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, F.col(value).alias("percentile"))


def noisy_or(events: DataFrame) -> DataFrame:
    """(source_id, witness_id, saturation, events): 1 - prod(1 - credit) of each pair."""
    one = F.max(F.when(F.col("credit") >= 1, 1).otherwise(0)) == 1
    rest = -F.expm1(F.sum(F.log1p(-F.least("credit", F.lit(1 - 1e-15)))))
    return events.groupBy("source_id", "witness_id").agg(F.when(one, 1.0).otherwise(rest).alias("saturation"), F.count("*").alias("events"))


def node_importance(saturations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Importance of every node: raw, normalised, percentile (0 for all if none has any), support, events."""
    by = saturations.groupBy(F.col("witness_id").alias("id")).agg(F.sum("saturation").alias("raw"), F.sum((F.col("saturation") > 0).cast("long")).alias("source_support"), F.sum("events").alias("witness_events"))
    full = nodes.select("id").distinct().join(by, "id", "left").na.fill(0)
    most = full.agg(F.max("raw").alias("most"))
    # Equal values (to 9 digits) have one share: they are counted first, and the counts are summed up by blocks.
    value = F.round("raw", 9)
    counts = running(full.groupBy(value.alias("value")).agg(F.count("*").alias("c")), "value", "c", "upto")
    share = counts.join(F.broadcast(full.agg(F.count("*").alias("n")))).select("value", (F.col("upto") / F.col("n")).alias("share"))
    out = full.join(F.broadcast(most)).withColumn("value", value).join(share, "value", "left")
    return out.select("id", "raw", (F.col("raw") / (F.col("most") + 1e-12)).alias("normalized"), F.when(F.col("most") > 0, F.col("share")).otherwise(0.0).alias("percentile"), "source_support", "witness_events")


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight): 2 where both directions are there, else 1."""
    return edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def modularity(pairs: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Of undirected (a, b, weight) under (id, community)."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))
    m = member.select(F.col("id"), "community")
    j = both.join(m.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(m.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    per = j.groupBy("cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("total"))
    all_ = per.agg(F.sum("total").alias("m2"))
    return per.join(F.broadcast(all_)).agg(F.sum(F.col("inside") / F.col("m2") - resolution * (F.col("total") / F.col("m2")) * (F.col("total") / F.col("m2"))).alias("modularity"))


def bfs_levels(edges: DataFrame, entries: DataFrame, depth: int = 32) -> DataFrame:
    """(id, level) reached from entries (id): one join a level, until no row is new."""
    seen = entries.select("id", F.lit(0).cast("long").alias("level")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.join(edges.select("src", "dst"), F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.select("id", F.lit(level).cast("long").alias("level")))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def coaccess(trace: DataFrame, window: int, least_hop: int, scope: str | None = None) -> DataFrame:
    """(node_a, node_b, together): pairs of nodes at most `window` rows apart in a query's trace.

    Rows are numbered in a query (and scope); a row meets the next `window` rows only, found by shifted
    numbers, so a long query costs rows times window, never its square.
    """
    by = ["query_id", scope] if scope else ["query_id"]
    rows = trace.where(F.col("hop") >= least_hop).select(*by, "hop", "node_id").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("hop", "node_id")))
    ahead = rows.select(*by, F.col("node_id").alias("other"), F.explode(F.sequence(F.col("n") - window, F.col("n") - 1)).alias("n"))
    pairs = rows.join(ahead, [*by, "n"]).where("node_id <> other")
    return pairs.groupBy(F.least("node_id", "other").alias("node_a"), F.greatest("node_id", "other").alias("node_b")).agg(F.count("*").alias("together"))


def live_rows(log: DataFrame) -> DataFrame:
    """(tag, seq, op) of tags whose last change is an insert; tag 0 and null tags are refused."""
    ok = log.where("tag is not null and tag <> 0")
    last = ok.groupBy("tag").agg(F.max(F.struct("seq", "op")).alias("last")).select("tag", "last.seq", "last.op")
    return last.where("op = 'insert'")


def repair_edges(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src, dst) after deletions: live neighbours, and the live neighbours of deleted ones."""
    gone = deleted.select("id").distinct()
    e = edges.select("src", "dst").distinct()
    alive = e.join(gone, F.col("src") == F.col("id"), "left_anti")
    kept = alive.join(gone, F.col("dst") == F.col("id"), "left_anti")
    lost = alive.join(gone, F.col("dst") == F.col("id"), "left_semi").withColumnRenamed("dst", "via")
    bridged = lost.join(e.select(F.col("src").alias("via"), F.col("dst")), "via").join(gone, F.col("dst") == F.col("id"), "left_anti").where("src <> dst").select("src", "dst")
    return kept.unionByName(bridged).distinct()


def gateways(cross: DataFrame, importance: DataFrame, shortlist: int) -> DataFrame:
    """Of each ordered community pair the best targets by (importance, id), with their least source.

    cross: (source_community, target_community, src, dst).
    """
    t = cross.groupBy("source_community", "target_community", F.col("dst").alias("target_node")).agg(F.min("src").alias("source_node"))
    t = t.join(importance.select(F.col("id").alias("target_node"), "importance"), "target_node", "left").na.fill(0.0, ["importance"])
    order = Window.partitionBy("source_community", "target_community").orderBy(F.desc("importance"), "target_node")
    return t.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).where(F.col("ordinal") < shortlist)


def select_gateways(candidates: DataFrame, count: int) -> DataFrame:
    """(source_community, target_community, ordinal, source_node, target_node): gateways apart in direction.

    candidates: gateways() of a shortlist, and a column direction (null where there is none). The most
    important comes first; each next one maximises 1 - its largest dot product with those chosen (0 if it has
    no direction to compare), ties by (importance, id).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal").reset_index(drop=True)  # that is by (importance, id): the first of a tie wins
        unit = [None if x is None else np.asarray(x, np.float64) for x in pdf["direction"]]
        chosen = [0]
        while len(chosen) < min(count, len(pdf)):
            best, most = -1, -1.0
            for i in range(len(pdf)):
                if i not in chosen:
                    dots = [min(1.0, max(-1.0, float(unit[i] @ unit[j]))) for j in chosen if unit[i] is not None and unit[j] is not None]
                    apart = 1 - max(dots) if dots else 0.0
                    if apart > most:
                        best, most = i, apart
            chosen.append(best)
        out = pdf.loc[chosen, ["source_community", "target_community", "source_node", "target_node"]]
        return out.assign(ordinal=range(len(chosen)))[["source_community", "target_community", "ordinal", "source_node", "target_node"]]

    pair = ["source_community", "target_community"]
    return candidates.select(*pair, "ordinal", "source_node", "target_node", "direction").groupBy(*pair).applyInPandas(run, "source_community long, target_community long, ordinal long, source_node long, target_node long")


def community_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, internal_edges, incoming_edges, outgoing_edges) of edges (src, dst) under (id, community)."""
    m = member.select("id", "community")
    j = edges.select("src", "dst").join(m.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").groupBy("a", "b").agg(F.count("*").alias("n"))
    same, none = F.col("a") == F.col("b"), F.lit(0).cast("long")
    out = j.select(F.col("a").alias("community"), F.when(same, F.col("n")).otherwise(0).alias("i"), none.alias("c"), F.when(~same, F.col("n")).otherwise(0).alias("o"))
    into = j.where(~same).select(F.col("b").alias("community"), none.alias("i"), F.col("n").alias("c"), none.alias("o"))
    return out.unionByName(into).groupBy("community").agg(F.sum("i").alias("internal_edges"), F.sum("c").alias("incoming_edges"), F.sum("o").alias("outgoing_edges"))


def modularity_gains(pairs: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, target, degree, gain): what moving a node to another community around it adds to the modularity."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))
    m = member.select("id", "community")
    degree = both.groupBy("u").agg(F.sum("weight").alias("degree"))
    own = degree.join(m.select(F.col("id").alias("u"), F.col("community").alias("home")), "u")
    total = own.groupBy("home").agg(F.sum("degree").alias("t"))
    near = both.join(m.select(F.col("id").alias("v"), F.col("community").alias("target")), "v").groupBy("u", "target").agg(F.sum("weight").alias("w"))
    stay = near.select("u", F.col("target").alias("home"), F.col("w").alias("w0"))
    x = near.join(own, "u").where("target <> home").join(stay, ["u", "home"], "left").na.fill(0, ["w0"])
    x = x.join(total.select(F.col("home").alias("target"), F.col("t").alias("there")), "target").join(total, "home").join(F.broadcast(total.agg((F.sum("t") / 2).alias("m"))))
    gain = (F.col("w") - F.col("w0")) / F.col("m") - resolution * F.col("degree") * (F.col("degree") + F.col("there") - F.col("t")) / (2 * F.col("m") * F.col("m"))
    return x.select(F.col("u").alias("id"), "target", "degree", gain.alias("gain"))


def importance_mass(rows: DataFrame, share: float) -> DataFrame:
    """The rows (id, mass) with the largest masses, ties to the smaller id, until they hold a share of the sum; none of none."""
    total = rows.agg(F.sum("mass")).first()[0] or 0
    if total <= 0:
        return rows.limit(0)
    before = running(rows.where("mass > 0").withColumn("_order", F.struct((-F.col("mass")).alias("m"), "id")), "_order", "mass", "_upto")
    return before.where(F.col("_upto") - F.col("mass") < share * total).select("id", "mass")


def recall_of_active(results: DataFrame, truth: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """(qid, recall): percent of the k; truth goes as far as its k-th active id, and ids as far away as that one."""
    live = truth.join(active.select("id").distinct().withColumn("live", F.lit(1)), "id", "left").na.fill(0, ["live"])
    live = live.withColumn("lives", F.sum("live").over(Window.partitionBy("qid").orderBy("rank")))
    bound = live.where((F.col("lives") < k) | ((F.col("lives") == k) & (F.col("live") == 1))).groupBy("qid").agg(F.max("distance").alias("bound"))
    wanted = truth.join(bound, "qid").where("distance <= bound").select("qid", "id")
    hits = results.where(F.col("rank") <= k).join(wanted, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) * 100.0 / k).alias("recall"))


def range_recall(queries: DataFrame, truth: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, recall): percent of the truth (qid, id) that is in the results; 100 where there is none."""
    n = truth.groupBy("qid").agg(F.count("*").alias("n"))
    hits = truth.select("qid", "id").join(results.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    x = queries.select("qid").distinct().join(n, "qid", "left").join(hits, "qid", "left").na.fill(0)
    return x.select("qid", F.when(F.col("n") == 0, 100.0).otherwise(100.0 * F.col("hits") / F.greatest("n", F.lit(1))).alias("recall"))


def label_ids(raw: DataFrame, dictionary: DataFrame, universal: int | None = None) -> DataFrame:
    """(raw, label) by a dictionary (raw, label); an unknown one is the universal label, or an error without one."""
    out = raw.join(dictionary, "raw", "left")
    if universal is None and out.where("label is null").limit(1).count():
        raise ValueError("unknown label, and no universal one")
    return out.select("raw", F.coalesce("label", F.lit(universal)).alias("label"))


def excluding(search, seen: DataFrame, k: int) -> DataFrame:
    """The k best of search(n) that aren't in seen (id, qid); n doubles until every query has k or all its rows came."""
    from .search import rank_per_query

    n, before = 4 * k, None
    while True:
        found = cut(search(n))
        left = found.join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        some = left.groupBy("qid").agg(F.count("*").alias("c"))
        short = found.select("qid").distinct().join(some, "qid", "left").where(F.coalesce("c", F.lit(0)) < k).limit(1).count()
        rows = found.count()
        if not short or rows == before:
            return rank_per_query(left.select("qid", "id", "distance"), k)
        n, before = 2 * n, rows


def exact_over(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(qid, id, distance) of both, the exact one where a pair is in both."""
    both = exact.select("qid", "id", F.col("distance").alias("e")).join(approximate.select("qid", "id", F.col("distance").alias("a")), ["qid", "id"], "full")
    return both.select("qid", "id", F.coalesce("e", "a").alias("distance"))


def require_disjoint(rows: DataFrame, key: str, split: str) -> DataFrame:
    """rows, or an error if a key is in more than one split."""
    if rows.groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").limit(1).count():
        raise ValueError(f"a {key} is in more than one {split}")
    return rows


def least_mixed(ids: DataFrame, k: int) -> DataFrame:
    """(id, mixed, rank): the k ids with the smallest values of a fixed 64-bit mixer, unsigned and as text."""

    def run(batches):
        for b in batches:
            if len(b):
                x = b["id"].to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                least = np.lexsort((b["id"], x))[:k]
                yield pd.DataFrame({"id": b["id"].to_numpy()[least], "mixed": [str(v) for v in x[least]]})

    mixed = ids.select("id").mapInPandas(run, "id long, mixed string")
    best = mixed.orderBy(F.col("mixed").cast("decimal(20,0)"), "id").limit(k)  # k rows
    return best.select("id", "mixed", F.row_number().over(Window.orderBy(F.col("mixed").cast("decimal(20,0)"), "id")).cast("long").alias("rank"))


def weighted_centroid(parts: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid) of parts (key, n, centroid): means of means, by their rows."""
    x = parts.select(key, "n", F.posexplode("centroid").alias("i", "x"))
    sums = x.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))


def disjoint_pairs(pairs: DataFrame, score: str) -> DataFrame:
    """(a, b, score): pairs taken in order of (score, a, b), the largest score first, if neither side was taken before.

    In rounds: a pair that comes first at both of its sides is taken, and its neighbours go. A round takes at least
    the first pair, and every pair it takes is one that the order would take.
    """
    left, taken = cut(pairs.select("a", "b", score)), None
    while left.limit(1).count():
        order = F.struct((-F.col(score)).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
        sides = left.select(F.col("a").alias("n"), order.alias("o")).unionByName(left.select(F.col("b").alias("n"), order.alias("o"))).groupBy("n").agg(F.min("o").alias("o"))
        first = left.join(sides.select(F.col("n").alias("a"), F.col("o").alias("oa")), "a").join(sides.select(F.col("n").alias("b"), F.col("o").alias("ob")), "b").where(F.col("oa") == F.col("ob")).select("a", "b", score)
        first = cut(first)
        taken = first if taken is None else taken.unionByName(first)
        gone = first.select(F.explode(F.array("a", "b")).alias("n"))
        left = cut(left.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b", score))
    return pairs.select("a", "b", score).limit(0) if taken is None else taken
