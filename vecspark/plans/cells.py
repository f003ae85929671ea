"""Building, placing, caching and publishing cells, layered search, and what queries showed of them.

Cells are runs of 16 ids and communities labels, where a query says nothing else; a trace is the near graph read as visits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark import sources
from vecspark.operators import cells as C
from vecspark.operators import layered as L
from vecspark.operators import pq as Q
from vecspark.operators import relational as R
from vecspark.operators.lineage import cut, shared_folder

from .common import E_SQL, G_SQL, L2, base, kept, query_set, r6, registrar
from .graphs import graph, members
from .rules import REPLAY, TR, replay, trace
from .search import codebook, coded, holds, holds_sql, mean_recall

REGISTRY, add = registrar()


def folder(spark, what):
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cell_members(spark, d):
    """(id, cell, community) of all nodes."""
    return members(spark, d).withColumn("cell", F.floor(F.col("id") / 16))


@add("w10_packed_cells", f"WITH RECURSIVE {E_SQL}, J AS (SELECT label, id // 16 AS cell, count(*) AS n FROM E GROUP BY ALL), K AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cell) AS r FROM J), W(label, r, cell, n, used, pack) AS (SELECT label, r, cell, n, n, 0::BIGINT FROM K WHERE r = 1 UNION ALL SELECT K.label, K.r, K.cell, K.n, CASE WHEN used + K.n > 16 THEN K.n ELSE used + K.n END, CASE WHEN used + K.n > 16 THEN pack + 1 ELSE pack END FROM W JOIN K ON K.label = W.label AND K.r = W.r + 1) SELECT label, cell, n, pack FROM W")
def packed(spark, d):
    """A community's parts of cells, packed side by side up to 16 nodes."""
    k = base(spark, d).groupBy("label", F.floor(F.col("id") / 16).alias("cell")).agg(F.count("*").alias("n"))
    return C.pack_cells(k, "label", "cell", "n", 16)


@add("a33_frontier_cache", f"WITH {G_SQL}, A AS (SELECT src // 16 AS client, dst // 16 AS page, dst, row_number() OVER (PARTITION BY src // 16 ORDER BY src, pos) AS n FROM G), Y AS (SELECT *, lag(n) OVER (PARTITION BY client, page ORDER BY n) AS prev FROM A), H AS (SELECT client, count(*) FILTER (prev IS NOT NULL AND (SELECT count(DISTINCT b.page) FROM A b WHERE b.client = Y.client AND b.n > Y.prev AND b.n < Y.n) < 4) AS hits FROM Y GROUP BY client), S AS (SELECT client, count(*) AS accesses, count(DISTINCT page) AS pages, 16 * count(DISTINCT page) - count(DISTINCT dst) AS padding FROM A GROUP BY client), U AS (SELECT client, count(*) AS runs FROM (SELECT DISTINCT client, page FROM A) x WHERE NOT EXISTS (SELECT 1 FROM A y WHERE y.client = x.client AND y.page = x.page - 1) GROUP BY client) SELECT S.client, accesses, hits, accesses - hits AS misses, greatest(accesses - hits - 4, 0) AS evictions, pages, padding, runs FROM S JOIN H ON S.client = H.client JOIN U ON S.client = U.client")
def frontier(spark, d):
    """What 16 queries in turn read through a cache of four pages; the pages, their unread slots and runs."""
    t = graph(spark, d).select(F.floor(F.col("src") / 16).alias("client"), "src", "pos", "dst", F.floor(F.col("dst") / 16).alias("page"))
    cached = C.lru_replay(t, "client", ["src", "pos"], "page", 4)
    pages = t.groupBy("client", "page").agg(F.countDistinct("dst").alias("n"))
    pages = pages.withColumn("gap", F.col("page") - F.lag("page").over(Window.partitionBy("client").orderBy("page")))
    whole = pages.groupBy("client").agg(F.count("*").alias("pages"), (16 * F.count("*") - F.sum("n")).alias("padding"), F.sum((F.coalesce("gap", F.lit(2)) > 1).cast("long")).alias("runs"))
    return cached.join(whole, "client")


@add("g19_assigned_cells", f"WITH {E_SQL} SELECT id // 8 AS cell_id, id % 8 AS \"order\", id, 0::BIGINT AS community_id FROM E")
def assigned(spark, d):
    """Cells as an assignment read from a CSV file says, after it was checked."""
    nodes = base(spark, d).select("id")
    rows = nodes.select(F.col("id").alias("node_id"), F.lit(0).cast("long").alias("community_id"), F.floor(F.col("id") / 8).alias("cell_id"), (F.col("id") % 8).alias("order"))
    path = folder(spark, "assignment")
    rows.write.csv(path, header=True)
    read = spark.read.schema("node_id long, community_id long, cell_id long, `order` long").csv(path, header=True)
    return C.assigned_cells(nodes, read, 8)


PAGES = "PG AS (SELECT label AS cell, count(*) AS n, ceil(count(*) / 16.0)::BIGINT AS pages FROM E GROUP BY label), PF AS (SELECT cell, pages, sum(pages) OVER (ORDER BY cell)::BIGINT - pages AS first FROM PG), PM AS (SELECT E.id, label AS cell_id, row_number() OVER (PARTITION BY label ORDER BY E.id) - 1 AS o FROM E), PL AS (SELECT id, cell_id, first + o // 16 AS page, o % 16 AS slot FROM PM JOIN PF ON cell_id = cell)"


def pages(spark, d):
    m = members(spark, d).select(F.col("community").alias("cell_id"), "id")
    return C.cell_pages(m.withColumn("order", F.row_number().over(Window.partitionBy("cell_id").orderBy("id")) - 1), 16)


@add("v28_s22_cell_pages", f"WITH {E_SQL}, {PAGES} SELECT id, cell_id, page, slot FROM PL")
def cell_pages(spark, d):
    return pages(spark, d).select("id", "cell_id", "page", F.col("slot"))


@add("j19_lookups", f"WITH {E_SQL}, {PAGES}, M AS (SELECT page, list(id ORDER BY slot) AS ids FROM PL GROUP BY page) SELECT PL.id, cell_id, PL.page, slot, array_to_string(ids, ',') AS page_members FROM PL JOIN M ON PL.page = M.page WHERE PL.id % 20 = 0")
def lookups(spark, d):
    """Of the query set each node's cell and page, and who shares the page, in order."""
    p = cut(pages(spark, d))
    asked = p.where("id % 20 = 0")
    packets = p.join(asked.select("page").distinct(), "page", "left_semi").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "id"))), lambda x: x["id"].cast("string")), ",").alias("page_members"))
    return asked.join(packets, "page").select("id", "cell_id", "page", "slot", "page_members")


@add("w15_linked_placement", holds_sql("every_node_once", "places_are_dense", "more_links_in_a_page"))
def linked_placement(spark, d):
    """Nodes of a label placed by their links: a place each, and more links in a page of 8 than in order of ids."""
    m = members(spark, d).select("id", F.col("community").alias("cell"))
    placed = cut(C.place_by_links(graph(spark, d), m, 8))
    by_id = m.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("id")) - 1)

    def together(rows):
        at = rows.select("id", "cell", F.floor(F.col("place") / 8).alias("page"))
        e = graph(spark, d).join(at.select(F.col("id").alias("src"), F.col("cell").alias("a"), F.col("page").alias("p")), "src").join(at.select(F.col("id").alias("dst"), F.col("cell").alias("b"), F.col("page").alias("q")), "dst")
        return e.where("a = b and p = q").count()

    dense = placed.groupBy("cell").agg((F.countDistinct("place") == F.count("*")).alias("x"), (F.max("place") == F.count("*") - 1).alias("y")).where("not (x and y)").limit(1).count() == 0
    once = placed.count() == m.count() and m.join(placed.select("id"), "id", "left_anti").limit(1).count() == 0
    return holds(spark, every_node_once=once, places_are_dense=dense, more_links_in_a_page=together(placed) >= together(by_id))


def trained_cells(spark, d):
    t = trace(spark, d)
    return C.coaccess_cells(R.coaccess(t, 3, 2), t.groupBy("node_id").agg(F.count("*").alias("visit_count")), cell_members(spark, d).withColumnRenamed("cell", "source_cell"), 16)


@add("g24_coaccess_cells", holds_sql("every_node_once", "at_most_the_target", "orders_are_dense"))
def coaccess_cells(spark, d):
    """Cells of nodes visited together: each node is in one, none has over 16 nodes, and these are numbered."""
    found = cut(trained_cells(spark, d))
    size = found.groupBy("community", "cell").agg(F.count("*").alias("n"), F.countDistinct("order").alias("k"), F.max("order").alias("m"))
    whole = members(spark, d).join(found, "id", "full").where("cell is null").limit(1).count() == 0 and found.groupBy("id").count().where("count > 1").limit(1).count() == 0
    return holds(spark, every_node_once=whole, at_most_the_target=size.where("n > 16").limit(1).count() == 0, orders_are_dense=size.where("k <> n or m <> n - 1").limit(1).count() == 0)


@add("g25_v26_locality_cells", "SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS cell_id, (row_number() OVER (ORDER BY vec_id) - 1) % 16 AS \"order\" FROM embeddings")
def locality(spark, d):
    """Cells of 16 nodes in order of their codes' interleaved key: the cells and places that are filled."""
    return C.locality_cells(coded(spark, d), codebook(spark, d), 16).select("cell_id", "order")


@add("a10_seeded_pq", holds_sql("another_seed_differs", "same_seed_same_codes", "under_half_the_spread"))
def seeded(spark, d):
    """Codes of two trainings with one seed are the same, and any of them leaves under half of the spread."""
    from vecspark.operators.index import sample_matrix

    x = sample_matrix(base(spark, d), 2000)
    a, b, c = (Q.train_codebook(x, 16, 32, seed=s) for s in (4, 4, 5))
    left = ((x - Q.decode(a, Q.encode(a, x))) ** 2).sum() / ((x - x.mean(0)) ** 2).sum()
    return holds(spark, same_seed_same_codes=(a == b).all(), another_seed_differs=(a != c).any(), under_half_the_spread=left < 0.5)


@add("j14_s15_layered_search", holds_sql("an_entry_layer", "rank_by_distance_and_id", "recall_10"))
def layered(spark, d):
    """A layered index written and opened again: recall@10 of at least 0.9 for the query set."""
    e = base(spark, d)
    index = kept(spark, d, "layers", lambda: L.build_layers(e, folder(spark, "layers")))
    found = cut(L.layered_topk(query_set(e), index, 10, 80))
    w = Window.partitionBy("qid").orderBy("distance", "id")
    wrong = found.withColumn("r", F.row_number().over(w)).where("r <> rank").limit(1).count()
    return holds(spark, an_entry_layer=index.agg(F.max("layer")).first()[0] >= 1, rank_by_distance_and_id=not wrong, recall_10=mean_recall(spark, d, found) >= 0.9)


@add("t9_start_points", "SELECT unnest(range(16)) AS id, 3.0::DOUBLE AS radius, 24::BIGINT AS dim, true AS is_frozen")
def start_points(spark, d):
    p = C.sphere_points(spark, 16, 24, 3.0, 7)
    return p.select("id", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("radius"), F.size("vec").cast("long").alias("dim"), "is_frozen")


@add("a20_index_size", "SELECT (8 + count(*) * 64 * 4)::BIGINT AS bytes FROM embeddings WHERE vec_id % 20 = 0")
def index_size(spark, d):
    """Bytes of the files with a prefix: here the query set in binary form."""
    p = folder(spark, "size")
    sources.save_bin(query_set(base(spark, d)).select(F.col("qid").alias("id"), F.col("qvec").alias("vec")), f"{p}/index_data.bin")
    return spark.read.format("binaryFile").load(f"{p}/index_*").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@add("m2_reached_communities", f"WITH {TR} SELECT query_id, community, count(*) AS support, min(hop) AS first_hop FROM TR GROUP BY ALL")
def reached(spark, d):
    """Communities that a query's expansions reached, with their number and the first."""
    return trace(spark, d).groupBy("query_id", "community").agg(F.count("*").alias("support"), F.min("hop").alias("first_hop"))


@add("m15_phases", f"WITH {TR} SELECT query_id, CASE WHEN hop < 5 THEN 'approach' ELSE 'convergence' END AS phase, count(*) AS expansions, count(DISTINCT cell) AS cells, round(avg(distance), 6) AS mean_distance FROM TR GROUP BY ALL")
def phases(spark, d):
    """Before and from the marker, hop 5: expansions, cells and the mean distance."""
    phase = F.when(F.col("hop") < 5, "approach").otherwise("convergence")
    return trace(spark, d).groupBy("query_id", phase.alias("phase")).agg(F.count("*").alias("expansions"), F.countDistinct("cell").alias("cells"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@add("m16_observed_proposals", f"WITH {TR}, PP AS (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(distance), cell) AS rank FROM TR WHERE hop <= 4 GROUP BY query_id, cell), L AS (SELECT query_id, cell, count(*) AS later, min(hop) AS first_later FROM TR WHERE hop > 4 GROUP BY ALL) SELECT PP.query_id, PP.rank, PP.cell, coalesce(later, 0) AS later_expanded, first_later FROM PP LEFT JOIN L ON PP.query_id = L.query_id AND PP.cell = L.cell WHERE PP.rank <= 2")
def observed(spark, d):
    """Two cells that would be proposed at hop 4, never used, and what the walk itself expanded of them later."""
    t = trace(spark, d)
    p = t.where("hop <= 4").groupBy("query_id", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("best"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "best", "cell")).cast("long")).where("rank <= 2")
    later = t.where("hop > 4").groupBy("query_id", "cell").agg(F.count("*").alias("later_expanded"), F.min("hop").alias("first_later"))
    return p.join(later, ["query_id", "cell"], "left").select("query_id", "rank", "cell", F.coalesce("later_expanded", F.lit(0)).alias("later_expanded"), "first_later")


@add("m21_route_profile", f"WITH {TR}, B AS (SELECT label AS center, list(m ORDER BY i) AS cvec FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM E) GROUP BY label, i) GROUP BY label), O AS (SELECT id, center FROM (SELECT E.id, center, row_number() OVER (PARTITION BY E.id ORDER BY round({L2.format(a='vec', b='cvec')}, 12), center) AS r FROM E, B) WHERE r = 1), N AS (SELECT center, cell, row_number() OVER (PARTITION BY center ORDER BY count(*) DESC, cell) AS rank FROM TR JOIN O ON TR.query_id = O.id WHERE TR.query_id % 20 <> 0 GROUP BY center, cell) SELECT O.id AS query_id, rank, cell FROM O JOIN N ON O.center = N.center WHERE rank <= 4 AND O.id % 20 = 0")
def route_profile(spark, d):
    """The query set routed to the four cells that the other queries of their bucket visited most."""
    e = base(spark, d)
    buckets = R.centroid(e, "label").select(F.col("label").alias("center"), F.col("centroid").alias("cvec"))
    return C.route_profile(e.where("id % 20 = 0"), e.where("id % 20 <> 0"), trace(spark, d).select("query_id", "cell"), buckets, 4)


@add("m19_t7_published_mapping", f"WITH {TR}, {REPLAY}, MG AS (SELECT a, b FROM RP WHERE joint >= 2 AND joint * 1.0 / merged >= 0.05) SELECT DISTINCT E.id // 16 AS cell, coalesce(MG.a, E.id // 16) AS target, 1::BIGINT AS generation, true AS stale_is_an_error FROM E LEFT JOIN MG ON MG.b = E.id // 16")
def published(spark, d):
    """Cells that queries touch together, merged in a mapping that is published once; a second one of the same state is refused."""
    merges = replay(spark, d).where((F.col("joint") >= 2) & (F.col("joint") / F.col("merged") >= 0.05)).select("a", "b")
    now = cell_members(spark, d).select("cell").distinct().withColumn("target", F.col("cell"))
    path = folder(spark, "mapping")
    mapping = C.merged_mapping(now, merges)
    generation = C.publish_mapping(mapping, path, 0)
    try:
        C.publish_mapping(mapping, path, 0)
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(f"{path}/generation={generation}").select("cell", "target", F.lit(generation).cast("long").alias("generation"), F.lit(refused).alias("stale_is_an_error"))


@add("s19_telemetry_tables", f"WITH {TR} SELECT query_id, hop AS expansion_ordinal, node_id, community AS community_id, cell AS cell_id, round(distance, 6) AS distance FROM TR")
def telemetry(spark, d):
    """The base trace written as CSV and read back by its schema."""
    p = folder(spark, "trace")
    trace(spark, d).select("query_id", F.col("hop").alias("expansion_ordinal"), "node_id", F.col("community").alias("community_id"), F.col("cell").alias("cell_id"), "distance").write.csv(p, header=True)
    read = spark.read.schema("query_id long, expansion_ordinal long, node_id long, community_id long, cell_id long, distance double").option("enforceSchema", False).csv(p, header=True)
    return read.select("query_id", "expansion_ordinal", "node_id", "community_id", "cell_id", r6("distance"))
