"""Vector, metric, quantiser and evaluation queries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark.functions import budgets
from vecspark.functions import vectors as V
from vecspark.operators import index as I
from vecspark.operators import pq as Q
from vecspark.operators import relational as R
from vecspark.operators import search as S
from vecspark.operators.lineage import cut, shared_folder

from .common import DOT, E_SQL, L2, S_SQL, base, kept, load, query_set, r6, registrar, vec_sql, vec_text

REGISTRY, add = registrar()
QV = "Q AS (SELECT id AS qid, vec AS qvec FROM E WHERE id % 20 = 0)"
D_L2, D_DOT = L2.format(a="vec", b="qvec"), DOT.format(a="vec", b="qvec")
N2 = lambda v: f"list_sum(list_transform({v}, lambda x: x * x))"


def _topk_sql(dist: str, cte: str = S_SQL, where: str = "", k: int = 10, value: str = "distance") -> str:
    return f"WITH {cte}, {QV}, D AS (SELECT qid, id, {dist} AS distance FROM E, Q {where}) SELECT qid, rank, id, round({value}, 6) + 0.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM D) WHERE rank <= {k}"


def _metric(name: str, metric: str, dist: str, sign: float = 1.0) -> None:
    sql = _topk_sql(dist, value="distance" if sign > 0 else "-distance")

    @add(f"j1_exact_topk_{name}", sql)
    def query(spark, d):
        e = base(spark, d, scaled=True)
        return S.exact_topk(query_set(e), e, 10, metric).select("qid", "rank", "id", (F.round(F.col("distance") * sign, 6) + 0.0).alias("distance"))


_metric("l2", "l2", D_L2)
_metric("cosine", "cosine", f"1 - {D_DOT} / (sqrt({N2('vec')}) * sqrt({N2('qvec')}))")
_metric("inner_product", "ip", f"-{D_DOT}", -1.0)
_metric("fast_l2", "fast_l2", f"{N2('vec')} - 2 * {D_DOT}")


def with_query(e):
    """Each row beside the query whose id is the last one divisible by 20: an equi-join, a pair a row."""
    return e.join(query_set(e), F.col("qid") == F.col("id") - F.col("id") % 20)


@add("v1_l2_expression", f"WITH {S_SQL}, {QV} SELECT qid, id, round({D_L2}, 6) AS distance FROM E JOIN Q ON qid = id - id % 20")
def l2_expression(spark, d):
    return with_query(base(spark, d, scaled=True)).select("qid", "id", F.round(V.l2(F.col("vec"), F.col("qvec")), 6).alias("distance"))


@add("v2_v12_u8_l2", f"WITH {E_SQL}, U AS (SELECT id, list_transform(vec, lambda x: least(255, greatest(0, round((x + 1) * 127.5)))::INT) AS vec, list_transform(vec, lambda x: least(127, greatest(-128, round(x * 127)))::INT) AS i8 FROM E) SELECT b.id, {L2.format(a='b.vec', b='q.vec')}::BIGINT AS u8, {L2.format(a='b.i8', b='q.i8')}::BIGINT AS i8 FROM U b JOIN U q ON q.id = b.id - b.id % 20")
def byte_l2(spark, d):
    """Squared distances of the vectors as unsigned and as signed bytes."""
    e = base(spark, d)
    u = with_query(e.select("id", V.quantize_u8(F.col("vec"), 127.5, 1.0).alias("vec"))).select("id", V.l2(F.col("vec"), F.col("qvec")).cast("long").alias("u8"))
    i = with_query(e.select("id", V.quantize_i8(F.col("vec"), 127.0).alias("vec"))).select("id", V.l2(F.col("vec"), F.col("qvec")).cast("long").alias("i8"))
    return u.join(i, "id")


UNIT = "list_transform(vec, lambda x: x / sqrt({n}))"


@add("v5_v8_normalize", f"WITH {S_SQL}, U AS (SELECT id, {N2('vec')} AS n, {UNIT.format(n=N2('vec'))} AS unit FROM E) SELECT b.id, round(sqrt(b.n), 6) AS norm, {vec_sql('b.unit')} AS unit, round(1 - {DOT.format(a='b.unit', b='q.unit')}, 6) + 0.0::DOUBLE AS distance FROM U b JOIN U q ON q.id = b.id - b.id % 20")
def normalize(spark, d):
    """Norms, unit vectors, and the normalised cosine distance to a query."""
    e = base(spark, d, scaled=True).withColumn("norm", F.sqrt(V.squared_norm(F.col("vec")))).withColumn("vec", V.normalize(F.col("vec")))
    distance = F.round(1 - V.dot(F.col("vec"), F.col("qvec")), 6) + 0.0
    return with_query(e).select("id", F.round("norm", 6).alias("norm"), vec_text(F.col("vec")).alias("unit"), distance.alias("distance"))


@add("v9_normalize_file", f"WITH {S_SQL} SELECT id, {vec_sql(UNIT.format(n=N2('vec') + ' + 1.1920928955078125e-07'))} AS unit FROM E")
def normalize_file(spark, d):
    return base(spark, d, scaled=True).select("id", vec_text(V.normalize(F.col("vec"), V.FILE_EPSILON)).alias("unit"))


@add("v10_mips_to_l2", f"WITH {S_SQL}, M AS (SELECT max(sqrt({N2('vec')})) AS m FROM E) SELECT id, len(vec) + 1 AS dim, round(sqrt(greatest(0, 1 - {N2('vec')} / (m * m))), 6) AS last FROM E, M")
def mips(spark, d):
    e = base(spark, d, scaled=True)
    most = e.agg(F.max(F.sqrt(V.squared_norm(F.col("vec")))).alias("m"))
    a = V.augment_for_ip(F.col("vec"), F.col("m"))
    return e.join(F.broadcast(most)).select("id", a.alias("a")).select("id", F.size("a").cast("long").alias("dim"), F.round(F.element_at("a", -1), 6).alias("last"))


@add("s3_s4_padded_matrix", "SELECT label::BIGINT AS label, count(*) AS npts, max(len(embedding))::BIGINT AS dim, max(len(embedding) + ((24 - len(embedding) % 24) % 24))::BIGINT AS aligned_dim FROM embeddings GROUP BY label")
def padded(spark, d):
    e = load(spark, d, "embeddings").withColumn("p", V.pad_to(F.col("embedding"), 24))
    return e.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("npts"), F.max(F.size("embedding")).cast("long").alias("dim"), F.max(F.size("p")).cast("long").alias("aligned_dim"))


@add("s25_s26_label_dictionary", "WITH T AS (SELECT unnest(string_split(replace(lang || ',' || source, chr(13), ''), ',')) AS token, doc_id FROM documents), F AS (SELECT token, min(doc_id) AS first, count(*) AS n FROM T GROUP BY token) SELECT token, n, row_number() OVER (ORDER BY first, token) + 1 AS label_id FROM F")
def label_dictionary(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.explode(F.split(F.regexp_replace(F.concat_ws(",", "lang", "source"), "\r", ""), ",")).alias("token"))
    f = t.groupBy("token").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return f.select("token", "n", (F.row_number().over(Window.orderBy("first", "token")) + 1).cast("long").alias("label_id"))


@add("s28_s29_label_vectors", f"WITH {E_SQL}, L AS (SELECT id, unnest([label, 100 + id % 3]) AS label FROM E) SELECT label, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM L GROUP BY label")
def label_vectors(spark, d):
    e = base(spark, d).select("id", F.explode(F.array(F.col("label"), 100 + F.col("id") % 3)).alias("label"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


LABELS = "[label, 100 + id % 3] || CASE WHEN id % 50 = 0 THEN [999] ELSE [] END"


def labelled(e):
    extra = F.when(F.col("id") % 50 == 0, F.array(F.lit(999).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return e.withColumn("labels", F.concat(F.array("label", 100 + F.col("id") % 3), extra))


@add("f1_j5_filtered_topk", _topk_sql(D_L2, S_SQL, "WHERE list_has_any([label, 100 + id % 3] || CASE WHEN id % 50 = 0 THEN [999::BIGINT] ELSE [] END, [3, 999])"))
def filtered(spark, d):
    e = base(spark, d, scaled=True)
    wanted = labelled(e).where(F.arrays_overlap("labels", F.array(F.lit(3).cast("long"), F.lit(999).cast("long"))))
    return S.exact_topk(query_set(e), wanted, 10).select("qid", "rank", "id", r6("distance"))


@add("f4_j6_active_topk", _topk_sql(D_L2, S_SQL, "WHERE id NOT IN (SELECT id FROM E WHERE id % 11 = 3)"))
def active(spark, d):
    e = base(spark, d, scaled=True)
    dead = e.where("id % 11 = 3").select("id")
    return S.exact_topk(query_set(e), e.join(dead, "id", "left_anti"), 10).select("qid", "rank", "id", r6("distance"))


@add("s9_range_truth", f"WITH {E_SQL}, {QV} SELECT qid, count(*) AS n, round(min({D_L2}), 6) AS nearest, round(max({D_L2}), 6) AS farthest FROM E, Q WHERE {D_L2} <= 1.8 GROUP BY qid")
def range_truth(spark, d):
    e = base(spark, d)
    f = S.range_search(query_set(e), e, 1.8)
    return f.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest"))


@add("s8_range_truth_percentiles", f"WITH {E_SQL}, {QV}, N AS (SELECT qid, count(*) FILTER (WHERE {D_L2} <= 1.8) AS n FROM E, Q GROUP BY qid), O AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM N) SELECT p.p::BIGINT AS percent, O.n FROM O, (SELECT unnest(range(0, 100, 5)) AS p) p WHERE O.i = least(p.p * O.c // 100, O.c - 1)")
def range_percentiles(spark, d):
    e = base(spark, d)
    q = query_set(e)
    n = q.select("qid").join(S.range_search(q, e, 1.8).groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").na.fill(0)
    o = n.select("n", (F.row_number().over(Window.orderBy("n")) - 1).alias("i")).join(F.broadcast(n.agg(F.count("*").alias("c"))))
    p = spark.range(0, 100, 5).withColumnRenamed("id", "percent")
    return o.join(F.broadcast(p), F.col("i") == F.least(F.floor(F.col("percent") * F.col("c") / 100), F.col("c") - 1)).select("percent", "n")


CENT = "CT AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM E) GROUP BY label, i) GROUP BY label)"
C_SQL = CENT + ", C AS (SELECT label AS center, centroid AS cvec FROM CT)"
NEAR = f"N AS (SELECT id, rank, center, distance FROM (SELECT id, center, {L2.format(a='vec', b='cvec')} AS distance, row_number() OVER (PARTITION BY id ORDER BY {L2.format(a='vec', b='cvec')}, center) AS rank FROM E, C) WHERE rank <= 3)"


def centers(e):
    """The centroids of the labels, one a label."""
    return R.centroid(e, "label").select(F.col("label").alias("center"), F.col("centroid").alias("cvec"))


@add("j2_nearest_centers", f"WITH {E_SQL}, {C_SQL}, {NEAR} SELECT id, rank, center, round(distance, 6) AS distance FROM N")
def nearest(spark, d):
    e = base(spark, d)
    return R.nearest_centers(e, centers(e), 3).select("id", "rank", "center", r6("distance"))


@add("j2_inverted_index_a12_shard_sizes", f"WITH {E_SQL}, {C_SQL}, {NEAR} SELECT center, count(*) AS n, list_sum(list(id))::BIGINT AS id_sum FROM N GROUP BY center")
def shard_sizes(spark, d):
    e = base(spark, d)
    return R.nearest_centers(e, centers(e), 3).groupBy("center").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@add("v14_residuals", f"WITH {E_SQL}, {C_SQL}, {NEAR} SELECT E.id, round(list_sum(list_transform(list_zip(vec, cvec), lambda z: abs(z[1] - z[2]))), 6) AS residual FROM E JOIN N ON E.id = N.id AND rank = 1 JOIN C ON N.center = C.center")
def residuals(spark, d):
    e = base(spark, d)
    c = centers(e)
    n = R.nearest_centers(e, c, 1).join(F.broadcast(c), "center").join(e, "id")
    return n.select("id", F.round(V._sum(F.transform(V.subtract(F.col("vec"), F.col("cvec")), lambda x: F.abs(x))), 6).alias("residual"))




@add("a1_centroids", f"WITH {E_SQL}, {CENT} SELECT label, {vec_sql('centroid')} AS centroid FROM CT")
def centroids(spark, d):
    c = R.centroid(base(spark, d), "label")
    return c.select("label", vec_text(F.col("centroid")).alias("centroid"))


MED = f"X AS (SELECT E.label, id, {L2.format(a='vec', b='centroid')} AS distance FROM E JOIN CT ON E.label = CT.label)"


@add("a2_medoids", f"WITH {E_SQL}, {CENT}, {MED} SELECT label, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS r FROM X) WHERE r = 1")
def medoids(spark, d):
    return R.medoid(base(spark, d), "label").select("label", "id", r6("distance"))


@add("a23_group_geometry", f"WITH {E_SQL}, {CENT}, {MED} SELECT label, count(*) AS node_count, round(sqrt(max(distance)), 6) AS radius, round(sqrt(avg(distance)), 6) AS rms, round(sum(distance), 6) AS sse FROM X GROUP BY label")
def geometry(spark, d):
    e = base(spark, d)
    x = e.join(R.centroid(e, "label").select("label", "centroid"), "label").withColumn("distance", V.l2(F.col("vec"), F.col("centroid")))
    return x.groupBy("label").agg(F.count("*").alias("node_count"), F.round(F.sqrt(F.max("distance")), 6).alias("radius"), F.round(F.sqrt(F.avg("distance")), 6).alias("rms"), F.round(F.sum("distance"), 6).alias("sse"))


@add("a5_lloyd_step", f"WITH {E_SQL}, {C_SQL}, {NEAR}, A AS (SELECT center AS label, vec FROM E JOIN N ON E.id = N.id AND rank = 1), {CENT.replace('CT AS', 'LT AS').replace('FROM E)', 'FROM A)')} SELECT label AS center, {vec_sql('centroid')} AS centroid FROM LT")
def lloyd(spark, d):
    e = base(spark, d)
    a = e.join(R.nearest_centers(e, centers(e), 1).select("id", "center"), "id")
    return R.centroid(a, "center").select("center", vec_text(F.col("centroid")).alias("centroid"))


#: Chunks of 4 coordinates with 256 codes each, and candidates that are refined by their vectors.
CHUNKS, POOL = 16, 100


def codebook(spark, d):
    """Trained once a session on a bounded sample of the vectors."""
    return kept(spark, d, "codebook", lambda: Q.train_codebook(I.sample_matrix(base(spark, d)), CHUNKS))


def coded(spark, d):
    return kept(spark, d, "codes", lambda: Q.encode_table(base(spark, d), codebook(spark, d)))


def holds(spark, **named):
    """(name, holds): measured properties, true where they hold."""
    return spark.createDataFrame([(k, bool(v)) for k, v in named.items()], "name string, holds boolean")


def all_hold(rows, names):
    """(name, holds): properties that every row of a table has."""
    every = rows.agg(*(F.coalesce(F.bool_and(n), F.lit(True)).alias(n) for n in names))
    return every.unpivot([], list(names), "name", "holds")


def holds_sql(*names):
    """All of them should hold."""
    return "SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS name, true AS holds"


def mean_recall(spark, d, found, k=10):
    """Mean share, from 0 to 1, of the k nearest that were found for the query set, against brute force."""
    e = base(spark, d)
    truth = kept(spark, d, "truth", lambda: S.exact_topk(query_set(e), e, 20).withColumn("distance", F.round("distance", 9)))
    return R.recall_at_k(found, truth, k).agg(F.avg("recall") / 100).first()[0]


@add("a4_a6_pq_train", "SELECT unnest(range(16)) AS chunk, 256 AS codes, true AS under_half")
def pq_train(spark, d):
    """Of each chunk the codes, and whether quantising leaves under half of the spread."""
    x, book = I.sample_matrix(base(spark, d)), codebook(spark, d)
    left = (Q.decode(book, Q.encode(book, x)) - x) ** 2
    spread = (x - x.mean(0)) ** 2
    rows = [(i, len(book[i]), bool(left[:, 4 * i : 4 * i + 4].sum() * 2 < spread[:, 4 * i : 4 * i + 4].sum())) for i in range(CHUNKS)]
    return spark.createDataFrame(rows, "chunk long, codes int, under_half boolean")


@add("a8_pq_encode", "SELECT vec_id AS id, 16 AS chunks, true AS nearest FROM embeddings")
def encode(spark, d):
    """Whether no other code of a chunk is nearer, by the distances of a row's own table."""
    book = codebook(spark, d)

    def run(batches):
        for b in batches:
            if len(b):
                codes = np.vstack(b["codes"].to_list()).astype(np.int64)
                table = Q.tables(book, S._matrix(b["vec"]))
                own = np.take_along_axis(table, codes[:, :, None], 2)[:, :, 0]
                yield pd.DataFrame({"id": b["id"], "chunks": np.full(len(b), codes.shape[1], np.int32), "nearest": (own <= table.min(2) + 1e-9).all(1)})

    return coded(spark, d).mapInPandas(run, "id long, chunks int, nearest boolean")


@add("j9_pq_adc_topk", holds_sql("recall_10_of_30"))
def adc(spark, d):
    """Of the 10 nearest at least 0.9 are among the 30 with the least code distances."""
    e = base(spark, d)
    found = Q.adc_topk(query_set(e), coded(spark, d), codebook(spark, d), 30)
    return holds(spark, recall_10_of_30=mean_recall(spark, d, found.withColumn("rank", F.lit(1))) >= 0.9)


@add("j18_pq_refine", _topk_sql(D_L2, E_SQL))
def refine(spark, d):
    """The 10 nearest among the POOL candidates by codes; the SQL is exact search."""
    e = base(spark, d)
    q = query_set(e)
    return Q.refine(q, Q.adc_topk(q, coded(spark, d), codebook(spark, d), POOL), e, 10).select("qid", "rank", "id", r6("distance"))


@add("j10_pq_inflate", holds_sql("inflated_error", "ip_table", "symmetric"))
def inflate(spark, d):
    """Inflated vectors are off by what their codes' tables say, and code products and distances agree with theirs."""
    book = codebook(spark, d)
    rows = coded(spark, d).join(Q.reconstruction(coded(spark, d), book), "id")

    def run(batches):
        at = np.arange(CHUNKS)
        for b in batches:
            if len(b):
                x, codes = S._matrix(b["vec"]), np.vstack(b["codes"].to_list()).astype(np.int64)
                back, turned = Q.decode(book, codes), np.roll(codes, 1, axis=0)
                l2 = np.array([t[at, c].sum() for t, c in zip(Q.tables(book, x), codes, strict=True)])
                ip = np.array([t[at, c].sum() for t, c in zip(Q.tables(book, x, "ip"), codes, strict=True)])
                pair = ((back - np.roll(back, 1, axis=0)) ** 2).sum(1)
                yield pd.DataFrame({"inflated_error": np.isclose(l2, b["error"]), "ip_table": np.isclose(-ip, (x * back).sum(1)), "symmetric": np.isclose(Q.code_distance(book, codes, turned), pair)})

    names = ("inflated_error", "ip_table", "symmetric")
    return all_hold(rows.mapInPandas(run, ", ".join(f"{n} boolean" for n in names)), names)


@add("j12_lut_u8", holds_sql("u8_within_step", "u16_within_step", "u16_recall"))
def lut_bits(spark, d):
    """Distances by tables of 8 and 16 bits are off by at most half a step a chunk; those of 16 bits find as much."""
    e = base(spark, d)
    t = Q.tables(codebook(spark, d), I.sample_matrix(e, 200))
    near = {}
    for bits in (8, 16):
        whole, step, low = Q.quantized(t, bits)
        near[bits] = (np.abs(whole * step[:, None, None] + low[:, :, None] - t) <= step[:, None, None] * 0.5000001).all() and 0 <= whole.min() <= whole.max() < 1 << bits
    found = Q.adc_topk(query_set(e), coded(spark, d), codebook(spark, d), 30, bits=16)
    return holds(spark, u8_within_step=near[8], u16_within_step=near[16], u16_recall=mean_recall(spark, d, found.withColumn("rank", F.lit(1))) >= 0.9)


@add("j11_pq_chunk_subset", holds_sql("all_chunks", "half_of_them"))
def subset(spark, d):
    """Scoring every chunk is scoring all; every second one, scaled up, still finds most of the 10 among 100."""
    e = base(spark, d)
    q, book, codes = query_set(e), codebook(spark, d), coded(spark, d)
    half = mean_recall(spark, d, Q.adc_topk(q, codes, book, POOL, subset=2).withColumn("rank", F.lit(1)))
    a, b = Q.adc_topk(q, codes, book, 5), Q.adc_topk(q, codes, book, 5, subset=1)
    return holds(spark, all_chunks=a.exceptAll(b).count() == 0, half_of_them=half >= 0.5)


@add("j13_disk_pq_distance", holds_sql("code_distance_of_expanded"))
def disk_pq(spark, d):
    """Where vectors are kept as codes, a row's distance is that to its inflated vector."""
    e, book = base(spark, d), codebook(spark, d)
    found = Q.adc_topk(query_set(e), coded(spark, d), book, POOL).join(coded(spark, d).select("id", "codes"), "id").join(query_set(e), "qid")

    def run(batches):
        for b in batches:
            if len(b):
                want = ((Q.decode(book, np.vstack(b["codes"].to_list()).astype(np.int64)) - S._matrix(b["qvec"])) ** 2).sum(1)
                yield pd.DataFrame({"code_distance_of_expanded": np.isclose(b["distance"], want, atol=1e-6)})

    return all_hold(found.mapInPandas(run, "code_distance_of_expanded boolean"), ("code_distance_of_expanded",))


@add("a9_opq_rotation", holds_sql("orthogonal", "no_worse"))
def opq(spark, d):
    """The rotation is orthogonal, and codes of rotated vectors lose no more than those of the vectors."""
    x = I.sample_matrix(base(spark, d), 2000)
    r, book = Q.train_rotation(x, 8, 64)
    plain = Q.train_codebook(x, 8, 64)
    loss = lambda c, y: float(((Q.decode(c, Q.encode(c, y)) - y) ** 2).sum())
    return holds(spark, orthogonal=np.allclose(r @ r.T, np.eye(len(r)), atol=1e-8), no_worse=loss(book, x @ r) <= loss(plain, x) * 1.01)


@add("a7_pq_chunk_bounds", "SELECT d.d AS dim, c.c AS chunks, i AS chunk, i * (d.d // c.c) + least(i, d.d % c.c) AS first FROM (SELECT unnest([7, 64, 100, 128]) AS d) d, (SELECT unnest([1, 3, 7]) AS c) c, (SELECT unnest(range(8)) AS i) WHERE i <= c.c")
def chunk_bounds(spark, d):
    rows = [(dim, c, i, b) for dim in (7, 64, 100, 128) for c in (1, 3, 7) for i, b in enumerate(budgets.pq_chunk_bounds(dim, c))]
    return spark.createDataFrame(rows, "dim int, chunks int, chunk long, first long")


@add("m11_search_budgets", "SELECT l AS search_l, least(40, 5 + ceil(l / 4.0) + CASE WHEN l <= 20 THEN 3 ELSE 0 END)::BIGINT AS approach, least(14, 9 + ceil(l / 25.0))::BIGINT AS refine, least(8, 2 + l // 30)::BIGINT AS hops, least(6, greatest(1, ceil(l / 25.0)))::BIGINT AS cells FROM (SELECT unnest([10, 20, 30, 40, 50, 75, 100, 125]) AS l)")
def budget_table(spark, d):
    rows = [(n, budgets.approach_hops(n, 5, 4, 40, 20, 3), budgets.refine_candidates(n), budgets.refine_hops(n, 2, 30, 8), budgets.routed_cells(n, 1, 25, 6)) for n in (10, 20, 30, 40, 50, 75, 100, 125)]
    return spark.createDataFrame(rows, "search_l int, approach long, refine long, hops long, cells long")


@add("a16_recall", f"WITH {E_SQL}, {QV}, D AS (SELECT qid, id, {D_L2} AS distance FROM E, Q), R AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY round(distance, 9)) AS r FROM D), F AS (SELECT * FROM D WHERE id % 3 <> 0), A AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS k FROM F) WHERE k <= 10) SELECT R.qid, count(A.id) * 100.0::DOUBLE / 10 AS recall FROM R LEFT JOIN A ON A.qid = R.qid AND A.id = R.id WHERE R.r <= 10 GROUP BY R.qid")
def recall(spark, d):
    """Of an index that lacks a third of the rows."""
    e = base(spark, d)
    truth = S.exact_topk(query_set(e), e, 20).withColumn("distance", F.round("distance", 9))
    return R.recall_at_k(S.exact_topk(query_set(e), e.where("id % 3 <> 0"), 10), truth, 10)


@add("a18_floor_percentiles", "WITH X AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p95 FROM X WHERE i = least(floor(n * 0.95), n - 1)")
def percentiles(spark, d):
    return R.floor_percentile(load(spark, d, "events"), "value", 0.95, "event_type").withColumnRenamed("percentile", "p95")


@add("a19_run_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, round(avg(CASE WHEN value > 50 THEN value END), 6) AS mean_over FROM events GROUP BY event_type")
def run_metrics(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.avg(F.when(F.col("value") > 50, F.col("value"))), 6).alias("mean_over"))


POLAR = f"WITH {E_SQL}, {CENT}, {MED}, Y AS (SELECT label, id, sqrt(distance) AS r, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS n, count(*) OVER (PARTITION BY label) AS c FROM X)"


def polar(spark, d):
    e = base(spark, d)
    x = e.join(R.centroid(e, "label").select("label", "centroid"), "label").withColumn("r", V.radius(F.col("vec"), F.col("centroid")))
    w = Window.partitionBy("label")
    return x.withColumn("n", F.row_number().over(w.orderBy("r", "id"))).withColumn("c", F.count("*").over(w))


@add("v16_v18_v19_radial_bins", POLAR + ", B AS (SELECT label, list(r ORDER BY n) FILTER (n = ceil(c * 1 / 4.0) OR n = ceil(c * 2 / 4.0) OR n = ceil(c * 3 / 4.0)) AS bounds FROM Y GROUP BY label) SELECT Y.label, id, round(r, 6) AS radius, len(list_filter(bounds, lambda b: b < r)) AS bin FROM Y JOIN B ON Y.label = B.label")
def radial(spark, d):
    p = polar(spark, d)
    cut = (F.col("n") == F.ceil(F.col("c") / 4)) | (F.col("n") == F.ceil(F.col("c") * 2 / 4)) | (F.col("n") == F.ceil(F.col("c") * 3 / 4))
    b = p.where(cut).groupBy("label").agg(F.array_sort(F.collect_list("r")).alias("bounds"))
    return p.join(b, "label").select("label", "id", F.round("r", 6).alias("radius"), V.radial_bin(F.col("r"), F.col("bounds")).cast("long").alias("bin"))


@add("w9_w11_radial_blocks", POLAR + " SELECT label, (n - 1) // 8 AS block, count(*) AS node_count, round(min(r), 6) AS min_radius, round(max(r), 6) AS max_radius FROM Y GROUP BY label, (n - 1) // 8")
def blocks(spark, d):
    return polar(spark, d).groupBy("label", F.floor((F.col("n") - 1) / 8).alias("block")).agg(F.count("*").alias("node_count"), F.round(F.min("r"), 6).alias("min_radius"), F.round(F.max("r"), 6).alias("max_radius"))


AX = CENT + ", A AS (SELECT label AS axis, centroid AS avec FROM CT)"


@add("v17_v20_direction_bins", POLAR.replace(f"{CENT}", AX) + f", B AS (SELECT label, list(r ORDER BY n) FILTER (n = ceil(c * 1 / 4.0) OR n = ceil(c * 2 / 4.0) OR n = ceil(c * 3 / 4.0)) AS bounds FROM Y GROUP BY label), W AS (SELECT Y.id, len(list_filter(bounds, lambda b: b < r)) AS bin FROM Y JOIN B ON Y.label = B.label), D AS (SELECT E.id, axis, {DOT.format(a='vec', b='avec')} AS d FROM E, A) SELECT D.id, axis AS direction_bin, axis * 4 + bin AS cell, axis AS back_direction, bin AS back_radial FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, axis) AS r FROM D) D JOIN W ON D.id = W.id WHERE D.r = 1")
def directions(spark, d):
    """The axis with the largest product, the radial bin, the cell of both, and both back from the cell."""
    e = base(spark, d)
    axes = centers(e).agg(F.array_sort(F.collect_list(F.struct(F.col("center").alias("axis"), F.col("cvec").alias("vec")))).alias("axes"))
    best = F.array_min(F.transform("axes", lambda a: F.struct((-V.dot(F.col("vec"), a["vec"])).alias("d"), a["axis"].alias("axis"))))
    x = e.join(F.broadcast(axes)).select("id", best["axis"].alias("direction_bin")).join(radial(spark, d).select("id", "bin"), "id")
    x = x.select("id", "direction_bin", V.cell_id(F.col("direction_bin"), F.col("bin"), 4).alias("cell"))
    return x.select("*", F.floor(F.col("cell") / 4).alias("back_direction"), (F.col("cell") % 4).alias("back_radial"))


@add("m8_block_lower_bound", POLAR + f", K AS (SELECT label, (n - 1) // 8 AS block, min(r) AS r0, max(r) AS r1 FROM Y GROUP BY ALL), Q AS (SELECT q.id AS qid, CT.label, sqrt({L2.format(a='q.vec', b='centroid')}) AS rho FROM E q, CT WHERE q.id % 20 = 0) SELECT qid, K.label, block, round(greatest(0, rho * rho + power(least(r1, greatest(r0, rho * cos(greatest(0, 0.9 - 0.5)))), 2) - 2 * rho * least(r1, greatest(r0, rho * cos(greatest(0, 0.9 - 0.5)))) * cos(greatest(0, 0.9 - 0.5))), 6) AS bound FROM K JOIN Q ON K.label = Q.label")
def lower_bound(spark, d):
    e = base(spark, d)
    k = polar(spark, d).groupBy("label", F.floor((F.col("n") - 1) / 8).alias("block")).agg(F.min("r").alias("r0"), F.max("r").alias("r1"))
    near = query_set(e).join(F.broadcast(R.centroid(e, "label").select("label", "centroid")))  # one row a label
    q = near.select("qid", "label", V.radius(F.col("qvec"), F.col("centroid")).alias("rho"))
    return k.join(q, "label").select("qid", "label", "block", F.round(V.block_lower_bound(F.col("rho"), F.col("r0"), F.col("r1"), F.lit(0.9), F.lit(0.5)), 6).alias("bound"))


ROUTE = f"RT AS (SELECT qid, label, rank FROM (SELECT q.id AS qid, CT.label, row_number() OVER (PARTITION BY q.id ORDER BY {L2.format(a='q.vec', b='centroid')}, CT.label) AS rank FROM E q, CT WHERE q.id % 20 = 0) WHERE rank <= 3)"


def route(e, cells=3):
    c = R.centroid(e, "label").select(F.col("label").alias("center"), F.col("centroid").alias("cvec"))
    n = R.nearest_centers(query_set(e).select(F.col("qid").alias("id"), F.col("qvec").alias("vec")), c, cells)
    return n.select(F.col("id").alias("qid"), F.col("center").alias("label"), "rank")


@add("m1_m7_j25_route_cells", f"WITH {E_SQL}, {CENT}, {ROUTE} SELECT * FROM RT")
def routed(spark, d):
    return route(base(spark, d)).select("qid", "label", "rank")


@add("m17_m22_routed_topk", f"WITH {E_SQL}, {CENT}, {ROUTE}, D AS (SELECT RT.qid, b.id, {L2.format(a='b.vec', b='q.vec')} AS distance FROM RT JOIN E b ON RT.label = b.label JOIN E q ON RT.qid = q.id) SELECT qid, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM D) WHERE rank <= 10")
def routed_topk(spark, d):
    e = base(spark, d)
    x = e.join(route(e).join(query_set(e), "qid"), "label").withColumn("distance", V.l2(F.col("vec"), F.col("qvec")))
    return S.rank_per_query(x.select("qid", "id", "distance"), 10).select("qid", "rank", "id", r6("distance"))


def index_of(spark, d):
    """The index of the vectors with their labels, built once a session in the shared folder."""
    def make():
        return I.build_index(labelled(base(spark, d)), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")

    return kept(spark, d, "index", make)


@add("j3_j4_g8_g9_index_search", holds_sql("recall_10", "rank_by_distance_and_id", "fewer_distances_than_rows"))
def index_search(spark, d):
    """Search of the index for the query set: recall@10 of at least 0.9 against brute force, for fewer distances."""
    e = base(spark, d)
    found = cut(index_of(spark, d).search(query_set(e), 10))
    n = e.count()
    order = found.withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where("o <> rank").count()
    return holds(spark, recall_10=mean_recall(spark, d, found) >= 0.9, rank_by_distance_and_id=order == 0, fewer_distances_than_rows=found.agg(F.avg("work")).first()[0] < n)


@add("j8_beam_search", holds_sql("recall_10"))
def beam(spark, d):
    """Search with a frontier in order of code distances: recall@10 of at least 0.9."""
    e = base(spark, d)
    return holds(spark, recall_10=mean_recall(spark, d, index_of(spark, d).search(query_set(e), 10, size=80, codebook=codebook(spark, d))) >= 0.9)


@add("j5_filtered_index_search", holds_sql("only_the_label", "recall_10", "unknown_label_is_an_error"))
def filtered_index(spark, d):
    """Results of one label only, found by a walk from its medoid too; an unknown label is refused."""
    e = labelled(base(spark, d))
    wanted = e.where(F.array_contains("labels", 3))
    found = cut(index_of(spark, d).search(query_set(e), 10, label=3))
    truth = S.exact_topk(query_set(e), wanted, 20).withColumn("distance", F.round("distance", 9))
    try:
        index_of(spark, d).search(query_set(e), 10, label=-5)
        refused = False
    except ValueError:
        refused = True
    return holds(spark, only_the_label=found.join(wanted, "id", "left_anti").count() == 0, recall_10=R.recall_at_k(found, truth, 10).agg(F.avg("recall")).first()[0] >= 90, unknown_label_is_an_error=refused)


@add("s13_s14_saved_index", f"WITH {E_SQL} SELECT id, true AS degree_in_bounds, true AS links_to_rows FROM E")
def saved_index(spark, d):
    """The index as it is read back: every row, with 1 to 1.3 * 16 links, to rows of the table."""
    nodes = index_of(spark, d).nodes
    links = nodes.select("cell", "part", "id", F.explode("adj").alias("dst"))
    wrong = links.join(base(spark, d).select(F.col("id").alias("dst")), "dst", "left_anti").select("id").distinct().withColumn("wrong", F.lit(True))
    size = nodes.groupBy("id").agg(F.min(F.size("adj")).alias("least"), F.max(F.size("adj")).alias("most"))
    return size.join(wrong, "id", "left").select("id", ((F.col("least") >= 1) & (F.col("most") <= 20)).alias("degree_in_bounds"), F.col("wrong").isNull().alias("links_to_rows"))


@add("g1_g4_vamana_graph")
def graph_build(spark, d):
    """(cell, part, src, pos, dst) of the index's graph."""
    return index_of(spark, d).nodes.select("cell", "part", F.col("id").alias("src"), F.posexplode("adj").alias("pos", "dst"))
