"""Graph, importance, community, cell and trace queries.

The graph is every row's 8 nearest others of all rows, which is what the SQL says, written once a session.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark.functions import vectors as V
from vecspark.operators import partition as P
from vecspark.operators import relational as R
from vecspark.operators.lineage import cut

from .common import E_SQL, G_SQL, GM_SQL, base, load, near_graph, r6, registrar

REGISTRY, add = registrar()
W_SQL = G_SQL + ", U AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM G GROUP BY ALL)"


def graph(spark, d):
    return near_graph(spark, d)


def members(spark, d):
    return base(spark, d).select("id", F.col("label").alias("community"))


@add("j16_w4_knn_graph", f"WITH {G_SQL} SELECT src, pos, dst, round(distance, 6) AS distance FROM G")
def knn(spark, d):
    return graph(spark, d).select("src", "pos", "dst", r6("distance"))


@add("g13_j22_partition_weights", f"WITH {W_SQL} SELECT a, b, weight FROM U")
def weights(spark, d):
    return R.undirected_weights(graph(spark, d))


@add("a21_j20_cross_edges", f"WITH {G_SQL} SELECT s.label AS source_community, t.label AS target_community, count(*) AS directed_cross_edge_count, count(DISTINCT dst) AS targets FROM G JOIN E s ON src = s.id JOIN E t ON dst = t.id WHERE s.label <> t.label GROUP BY ALL")
def cross_edges(spark, d):
    return cross(spark, d).groupBy("source_community", "target_community").agg(F.count("*").alias("directed_cross_edge_count"), F.countDistinct("dst").alias("targets"))


def cross(spark, d):
    m = members(spark, d)
    g = graph(spark, d).join(m.select(F.col("id").alias("src"), F.col("community").alias("source_community")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("target_community")), "dst")
    return g.where("source_community <> target_community")


@add("a24_edge_cut_a26_modularity", f"WITH {W_SQL}, J AS (SELECT u.*, s.label AS ca, t.label AS cb FROM U u JOIN E s ON a = s.id JOIN E t ON b = t.id), T AS (SELECT c, sum(w) AS tot FROM (SELECT ca AS c, weight AS w FROM J UNION ALL SELECT cb, weight FROM J) GROUP BY c), I AS (SELECT ca AS c, sum(weight) * 2 AS ins FROM J WHERE ca = cb GROUP BY ca), M AS (SELECT sum(weight) * 2.0 AS m2 FROM U) SELECT (SELECT sum(weight)::BIGINT FROM J WHERE ca <> cb) AS edge_cut, round(sum(coalesce(ins, 0) / m2 - (tot / m2) * (tot / m2)), 6)::DOUBLE AS modularity FROM T LEFT JOIN I USING (c), M")
def edge_cut(spark, d):
    u, m = R.undirected_weights(graph(spark, d)), members(spark, d)
    c = u.join(m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    crossing = c.agg(F.sum(F.when(F.col("ca") != F.col("cb"), F.col("weight")).otherwise(0)).alias("edge_cut"))
    return crossing.join(R.modularity(u, m)).select("edge_cut", F.round("modularity", 6).alias("modularity"))


@add("j21_two_hop_mode", f"WITH {G_SQL}, H AS (SELECT x.src, y.dst // 32 AS page, count(*) AS n FROM G x JOIN G y ON x.dst = y.src GROUP BY ALL) SELECT src, page, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, page) AS r FROM H) WHERE r = 1")
def two_hop(spark, d):
    g = graph(spark, d).select("src", "dst")
    h = g.withColumnRenamed("dst", "via").join(g.select(F.col("src").alias("via"), F.floor(F.col("dst") / 32).alias("page")), "via").groupBy("src", "page").agg(F.count("*").alias("n"))
    return h.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("m"), "page", "n")).alias("x")).select("src", "x.page", "x.n")


@add("a35_g31_bfs_levels", f"WITH RECURSIVE {GM_SQL}, B(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT G.dst, B.level + 1 FROM B JOIN G ON G.src = B.id WHERE B.level < 32) SELECT level::BIGINT AS level, count(*) AS n FROM (SELECT id, min(level) AS level FROM B GROUP BY id) GROUP BY level")
def bfs(spark, d):
    g = cut(graph(spark, d).select("src", "dst"))
    return R.bfs_levels(g, spark.range(1)).groupBy("level").agg(F.count("*").alias("n"))


@add("a36_degree_stats_g30_transpose", f"WITH {G_SQL} SELECT dst AS id, count(*) AS in_degree, min(src) AS first FROM G GROUP BY dst")
def degrees(spark, d):
    return graph(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.min("src").alias("first"))


EV = G_SQL + ", V AS (SELECT x.src AS source_id, w.dst AS witness_id, x.dst AS victim_id, sqrt(x.distance) AS d_sv, sqrt(p.distance) AS d_wv FROM G x JOIN G w ON x.src = w.src AND w.pos < x.pos JOIN P p ON p.src = w.dst AND p.dst = x.dst), C AS (SELECT source_id, witness_id, CASE WHEN d_sv <= 1e-12 THEN 0 ELSE least(1, greatest(0, greatest(0, 1 - 0.9 * d_wv / d_sv) * (CASE WHEN d_wv / d_sv < 1 THEN 1 - d_wv / d_sv ELSE 0 END))) END AS credit FROM V), Z AS (SELECT source_id, witness_id, CASE WHEN max(credit) >= 1 THEN 1 ELSE 1 - product(1 - credit) END AS saturation, count(*) AS events FROM C GROUP BY ALL), R AS (SELECT E.id, coalesce(sum(saturation), 0) AS raw, coalesce(sum((saturation > 0)::INT), 0)::BIGINT AS source_support, coalesce(sum(events), 0)::BIGINT AS witness_events FROM E LEFT JOIN Z ON E.id = witness_id GROUP BY E.id)"


def events(spark, d):
    """Prune events of the graph: nearer neighbours as witnesses of farther ones of the same source."""
    e, g = base(spark, d), graph(spark, d)
    pairs = g.select(F.col("src").alias("source_id"), F.col("dst").alias("victim_id"), F.col("distance").alias("d2"), "pos").join(g.select(F.col("src").alias("source_id"), F.col("dst").alias("witness_id"), F.col("pos").alias("wpos")), "source_id").where("wpos < pos")
    v = pairs.join(e.select(F.col("id").alias("victim_id"), F.col("vec").alias("vv")), "victim_id").join(e.select(F.col("id").alias("witness_id"), F.col("vec").alias("wv")), "witness_id")
    return v.withColumn("credit", V.event_credit(F.col("d2"), V.l2(F.col("wv"), F.col("vv")), F.lit(None).cast("double"), 0.9, squared=True))


def importance(spark, d):
    return R.node_importance(R.noisy_or(events(spark, d)), base(spark, d))


@add("a13_a14_saturation", f"WITH {EV} SELECT source_id, witness_id, round(saturation, 6) AS saturation, events FROM Z")
def saturation(spark, d):
    return R.noisy_or(events(spark, d)).select("source_id", "witness_id", r6("saturation"), "events")


@add("a15_w3_importance", f"WITH {EV} SELECT id, round(raw, 6) AS raw, round(raw / (max(raw) OVER () + 1e-12), 6) AS normalized, CASE WHEN max(raw) OVER () > 0 THEN round(cume_dist() OVER (ORDER BY round(raw, 9)), 6) ELSE 0 END AS percentile, source_support, witness_events FROM R")
def node_importance(spark, d):
    return importance(spark, d).select("id", r6("raw"), r6("normalized"), r6("percentile"), "source_support", "witness_events")


@add("w2_hub_ratio", f"WITH {EV} SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(raw, 9) DESC, id) AS rank, count(*) OVER () AS n FROM R) WHERE rank <= ceil(n * 0.05)")
def hubs(spark, d):
    """The share of nodes with the most importance: the ranked rows are the hubs only."""
    i = cut(importance(spark, d).select("id", F.round("raw", 9).alias("raw")))
    n = i.count()
    top = i.orderBy(F.desc("raw"), "id").limit(-(-n * 5 // 100))
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("raw"), "id")).cast("long").alias("rank"))


@add("a22_community_hub", f"WITH {EV} SELECT label AS community, id AS navigation_hub_id, node_count, minimum_node_id FROM (SELECT label, E.id, row_number() OVER (PARTITION BY label ORDER BY round(raw, 9) DESC, E.id) AS r, count(*) OVER (PARTITION BY label) AS node_count, min(E.id) OVER (PARTITION BY label) AS minimum_node_id FROM E JOIN R ON E.id = R.id) WHERE r = 1")
def community_hub(spark, d):
    x = importance(spark, d).join(members(spark, d), "id")
    return x.groupBy("community").agg(F.min(F.struct((-F.round("raw", 9)).alias("m"), "id"))["id"].alias("navigation_hub_id"), F.count("*").alias("node_count"), F.min("id").alias("minimum_node_id"))


@add("w5_w6_gateways", f"WITH {EV}, T AS (SELECT s.label AS source_community, t.label AS target_community, dst AS target_node, min(src) AS source_node FROM G JOIN E s ON src = s.id JOIN E t ON dst = t.id WHERE s.label <> t.label GROUP BY ALL) SELECT source_community, target_community, ordinal, source_node, target_node FROM (SELECT T.*, row_number() OVER (PARTITION BY source_community, target_community ORDER BY round(raw, 9) DESC, target_node) - 1 AS ordinal FROM T JOIN R ON target_node = id) WHERE ordinal < 4")
def gateways(spark, d):
    i = importance(spark, d).select("id", F.round("raw", 9).alias("importance"))
    return R.gateways(cross(spark, d), i, 4).select("source_community", "target_community", "ordinal", "source_node", "target_node")


@add("w6_gateway_selection")
def gateway_selection(spark, d):
    """Of each pair's 32 most important targets 8 gateways apart in direction, seen from the target community's centroid."""
    e = base(spark, d)
    i = cut(importance(spark, d).select("id", F.round("raw", 9).alias("importance")))
    pole = R.centroid(e, "label").select(F.col("label").alias("target_community"), F.col("centroid").alias("pole"))
    g = R.gateways(cross(spark, d), i, 32).join(pole, "target_community").join(e.select(F.col("id").alias("target_node"), "vec"), "target_node")
    return R.select_gateways(g.withColumn("direction", V.direction(F.col("vec"), F.col("pole"))), 8)


@add("g15_canonical_communities", f"WITH {E_SQL} SELECT label, dense_rank() OVER (ORDER BY min(id)) - 1 AS community FROM E GROUP BY label")
def canonical(spark, d):
    return base(spark, d).groupBy("label").agg(F.min("id").alias("m")).select("label", (F.dense_rank().over(Window.orderBy("m")) - 1).cast("long").alias("community"))


@add("g20_hierarchy_level", f"WITH {E_SQL}, K AS (SELECT label, id // 16 AS cell, count(*) AS n FROM E GROUP BY ALL), O AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cell) - 1 AS ord FROM K) SELECT label, ord // 4 AS parent, count(*) AS children, sum(n)::BIGINT AS descendants FROM O GROUP BY ALL")
def hierarchy(spark, d):
    k = base(spark, d).groupBy("label", F.floor(F.col("id") / 16).alias("cell")).agg(F.count("*").alias("n"))
    o = k.withColumn("ord", F.row_number().over(Window.partitionBy("label").orderBy("cell")) - 1)
    return o.groupBy("label", F.floor(F.col("ord") / 4).alias("parent")).agg(F.count("*").alias("children"), F.sum("n").alias("descendants"))


@add("g28_capacity_classes", "SELECT label, count(*) AS n, CASE WHEN count(*) <= 16 THEN 16 WHEN count(*) <= 32 THEN 32 WHEN count(*) <= 64 THEN 64 WHEN count(*) <= 128 THEN 128 END AS capacity FROM embeddings GROUP BY label")
def capacity(spark, d):
    return load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("capacity", V.capacity_class(F.col("n")))


@add("g29_adjacency_bytes", f"WITH {G_SQL}, D AS (SELECT src, dst - coalesce(lag(dst) OVER (PARTITION BY src ORDER BY dst), 0) AS delta FROM G) SELECT src, sum(CASE WHEN delta < 256 THEN 1 WHEN delta < 65536 THEN 2 ELSE 4 END)::BIGINT + 2 AS varint_bytes, count(*) * 4 AS raw_bytes FROM D GROUP BY src")
def adjacency(spark, d):
    delta = F.col("dst") - F.coalesce(F.lag("dst").over(Window.partitionBy("src").orderBy("dst")), F.lit(0))
    x = graph(spark, d).withColumn("delta", delta)
    return x.groupBy("src").agg((F.sum(F.when(F.col("delta") < 256, 1).when(F.col("delta") < 65536, 2).otherwise(4)) + 2).alias("varint_bytes"), (F.count("*") * 4).alias("raw_bytes"))


@add("a25_j24_cell_transitions", f"WITH {G_SQL}, T AS (SELECT src // 16 AS source_cell, dst // 16 AS target_cell, count(*) AS n FROM G WHERE src // 16 <> dst // 16 GROUP BY ALL), O AS (SELECT *, row_number() OVER (PARTITION BY source_cell ORDER BY n DESC, target_cell) AS r, sum(n) OVER (PARTITION BY source_cell)::BIGINT AS total FROM T) SELECT source_cell, target_cell, n, r AS rank, total FROM O WHERE r <= 2")
def transitions(spark, d):
    cell = lambda c: F.floor(F.col(c) / 16)
    t = graph(spark, d).where(cell("src") != cell("dst")).groupBy(cell("src").alias("source_cell"), cell("dst").alias("target_cell")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_cell")
    o = t.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "target_cell")).cast("long")).withColumn("total", F.sum("n").over(w))
    return o.where("rank <= 2").select("source_cell", "target_cell", "n", "rank", "total")


@add("w14_node_classes", f"WITH {G_SQL}, I AS (SELECT dst AS id, count(*) AS n FROM G GROUP BY dst) SELECT E.id, CASE WHEN coalesce(n, 0) >= 16 THEN 'hub' WHEN coalesce(n, 0) <= 4 THEN 'peripheral' ELSE 'normal' END AS class FROM E LEFT JOIN I ON E.id = I.id")
def classes(spark, d):
    i = graph(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return base(spark, d).select("id").join(i, "id", "left").select("id", F.when(n >= 16, "hub").when(n <= 4, "peripheral").otherwise("normal").alias("class"))


@add("w7_low_importance_trim", f"WITH {EV}, H AS (SELECT label, E.id, row_number() OVER (PARTITION BY label ORDER BY round(raw, 9), E.id) AS r, count(*) OVER (PARTITION BY label) AS n FROM E JOIN R ON E.id = R.id), L AS (SELECT id FROM H WHERE r <= n // 2), X AS (SELECT G.src, G.dst, row_number() OVER (PARTITION BY G.src ORDER BY round(raw, 9), G.dst DESC) AS k FROM G JOIN R ON G.dst = R.id) SELECT src, dst FROM X WHERE NOT (k = 1 AND src IN (SELECT id FROM L))")
def trim(spark, d):
    i = cut(importance(spark, d).select("id", F.round("raw", 9).alias("raw")))
    w = Window.partitionBy("community")
    low = i.join(members(spark, d), "id").withColumn("r", F.row_number().over(w.orderBy("raw", "id"))).withColumn("n", F.count("*").over(w)).where(F.col("r") <= F.floor(F.col("n") / 2)).select(F.col("id").alias("src"), F.lit(1).alias("low"))
    x = graph(spark, d).select("src", "dst").join(i.select(F.col("id").alias("dst"), "raw"), "dst")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("raw", F.desc("dst")))).join(low, "src", "left")
    return x.where("not (k = 1 and low is not null)").select("src", "dst")


@add("v28_page_layout", "WITH X AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings) SELECT id, slot // 16 AS page, (slot % 16) * 256 AS \"offset\" FROM X")
def layout(spark, d):
    e = R.numbered(load(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "slot")
    return e.select("id", F.floor(F.col("slot") / 16).alias("page"), ((F.col("slot") % 16) * 256).cast("long").alias("offset"))


@add("w8_page_runs", "WITH P AS (SELECT DISTINCT user_id AS q, event_id // 7 AS page FROM events), R AS (SELECT q, page, page - row_number() OVER (PARTITION BY q ORDER BY page) AS g FROM P) SELECT q, min(page) AS first, max(page) AS last, count(*) AS pages FROM R GROUP BY q, g")
def runs(spark, d):
    p = load(spark, d, "events").select(F.col("user_id").alias("q"), F.floor(F.col("event_id") / 7).alias("page")).distinct()
    g = p.withColumn("g", F.col("page") - F.row_number().over(Window.partitionBy("q").orderBy("page")))
    return g.groupBy("q", "g").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("pages")).drop("g")


TR = G_SQL + ", TR AS (SELECT src AS query_id, pos AS hop, dst AS node_id, E.label AS community, dst // 16 AS cell FROM G JOIN E ON dst = id)"


def trace(spark, d):
    m = members(spark, d)
    t = graph(spark, d).select(F.col("src").alias("query_id"), F.col("pos").alias("hop"), F.col("dst").alias("node_id"))
    return t.join(m.withColumnRenamed("id", "node_id"), "node_id").withColumn("cell", F.floor(F.col("node_id") / 16))


@add("a28_coaccess", f"WITH {TR}, O AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, node_id) AS n FROM TR WHERE hop >= 2) SELECT least(x.node_id, y.node_id) AS node_a, greatest(x.node_id, y.node_id) AS node_b, count(*) AS together FROM O x JOIN O y ON x.query_id = y.query_id AND y.n - x.n BETWEEN 1 AND 3 AND x.node_id <> y.node_id GROUP BY ALL")
def coaccess(spark, d):
    return R.coaccess(trace(spark, d), 3, 2)


@add("a37_node_visits", f"WITH {TR} SELECT node_id, count(*) AS visit_count FROM TR GROUP BY node_id")
def visits(spark, d):
    return trace(spark, d).groupBy("node_id").agg(F.count("*").alias("visit_count"))


@add("a29_replay_coverage", f"WITH {TR}, C AS (SELECT query_id, cell, count(*) AS n FROM TR GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cell) AS r, sum(n) OVER (PARTITION BY query_id) AS t FROM C) SELECT round(avg(cells), 6) AS mean_cells, round(avg(top1), 6) AS top1, round(avg(top4), 6) AS top4 FROM (SELECT query_id, count(*) AS cells, (sum(n) FILTER (r <= 1))::DOUBLE / max(t) AS top1, (sum(n) FILTER (r <= 4))::DOUBLE / max(t) AS top4 FROM R GROUP BY query_id)")
def coverage(spark, d):
    c = trace(spark, d).groupBy("query_id", "cell").agg(F.count("*").alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "cell")))
    q = r.groupBy("query_id").agg(F.count("*").alias("cells"), *((F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{k}") for k in (1, 4)))
    return q.agg(F.round(F.avg("cells"), 6).alias("mean_cells"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("top4"), 6).alias("top4"))


@add("a30_u6_f11_pair_metrics", f"WITH {TR}, C AS (SELECT DISTINCT query_id, cell FROM TR), J AS (SELECT x.cell AS a, y.cell AS b, count(*) AS joint FROM C x JOIN C y ON x.query_id = y.query_id AND x.cell < y.cell GROUP BY ALL), N AS (SELECT cell, count(*) AS n FROM C GROUP BY cell) SELECT a, b, joint, x.n + y.n - joint AS either, CASE WHEN joint < 4 THEN 'joint' WHEN joint * 10 < 3 * (x.n + y.n - joint) THEN 'coaccess' ELSE 'accepted' END AS verdict FROM J JOIN N x ON a = x.cell JOIN N y ON b = y.cell")
def pair_metrics(spark, d):
    """Cells touched by the same query: a trace has at most 8 nodes, so a query has at most 28 pairs."""
    c = trace(spark, d).select("query_id", "cell").distinct()
    cells = c.groupBy("query_id").agg(F.array_sort(F.collect_list("cell")).alias("cs"))
    j = cells.select(F.posexplode("cs").alias("i", "a"), "cs").select("a", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("joint"))
    n = c.groupBy("cell").agg(F.count("*").alias("n"))
    x = j.join(n.select(F.col("cell").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("cell").alias("b"), F.col("n").alias("nb")), "b")
    either = F.col("na") + F.col("nb") - F.col("joint")
    return x.select("a", "b", "joint", either.alias("either"), F.when(F.col("joint") < 4, "joint").when(F.col("joint") * 10 < 3 * either, "coaccess").otherwise("accepted").alias("verdict"))


@add("m3_source_support", f"WITH {TR} SELECT cell, count(DISTINCT query_id) AS support, min(hop) AS best_hop FROM TR GROUP BY cell HAVING count(DISTINCT query_id) >= 3")
def support(spark, d):
    return trace(spark, d).groupBy("cell").agg(F.countDistinct("query_id").alias("support"), F.min("hop").alias("best_hop")).where("support >= 3")


@add("w12_m20_cell_yield", f"WITH {TR}, C AS (SELECT query_id, cell, count(*) AS hits, min(hop) AS best FROM TR GROUP BY ALL) SELECT query_id, cell, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, best, cell) AS rank FROM C) WHERE rank <= 2")
def cell_yield(spark, d):
    c = trace(spark, d).groupBy("query_id", "cell").agg(F.count("*").alias("hits"), F.min("hop").alias("best"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "best", "cell")).cast("long")).where("rank <= 2").select("query_id", "cell", "hits", "rank")


@add("m23_sequential_reads", "WITH X AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT user_id, count(*) AS reads, count(*) FILTER (gap <= 3) AS sequential FROM X GROUP BY user_id")
def sequential(spark, d):
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return load(spark, d, "events").withColumn("gap", gap).groupBy("user_id").agg(F.count("*").alias("reads"), F.sum(F.coalesce((F.col("gap") <= 3).cast("long"), F.lit(0))).alias("sequential"))


@add("g14_g23_balanced_partition")
def balanced(spark, d):
    return P.balanced_partition(base(spark, d), 8)


@add("g22_recursive_cells")
def recursive(spark, d):
    return P.recursive_cells(base(spark, d), 32)


@add("a27_louvain_communities")
def louvain(spark, d):
    return P.louvain_communities(R.undirected_weights(graph(spark, d)))


@add("a11_spherical_kmeans")
def spherical(spark, d):
    return P.spherical_kmeans(base(spark, d), "label", 4)


@add("g17_graph_local_cells")
def graph_local(spark, d):
    return P.graph_local_cells(graph(spark, d), members(spark, d), 16)
