"""Golden values of the scalar rules, and the operators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import budgets
from vecspark.functions import vectors as V
from vecspark.operators import index as I
from vecspark.operators import partition as P
from vecspark.operators import relational as R
from vecspark.operators import search as S
from vecspark.sources import bin_bytes, read_bin, require_columns
from vecspark.streaming import apply_changes


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def smooth(n=300, dim=8):
    return [(p, [p * (0.01 + 0.002 * d) + float(np.sin((p + 17 * d) * 0.07)) for d in range(dim)]) for p in range(n)]


@pytest.mark.parametrize(("d", "w", "a", "want"), [(10.0, 9.0, None, 0.0), (10.0, 2.0, None, 0.608), (10.0, 2.0, 2.0, 0.0), (10.0, 2.0, 20.0, 0.608), (10.0, 2.0, 1.0, 0.0), (0.0, 2.0, None, 0.0)])
def test_event_credit(spark, d, w, a, want):
    assert one(spark, V.event_credit(F.lit(d), F.lit(w), F.lit(a).cast("double"))) == pytest.approx(want)


def test_polar_goldens(spark):
    p, h = F.array(F.lit(4.0), F.lit(6.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, V.radius(p, h)) == 5 and one(spark, V.direction(p, h)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.direction(p, p)) is None
    bounds = F.array(*map(F.lit, (2.0, 4.0, 6.0)))
    assert [one(spark, V.radial_bin(F.lit(x), bounds)) for x in (2.0, 2.1, 6.0, 7.0)] == [0, 1, 2, 3]
    assert one(spark, V.cell_id(F.lit(3), F.lit(2), 4)) == 14
    assert one(spark, V.cosine(p, F.array(F.lit(0.0), F.lit(0.0)))) is None
    with pytest.raises(ValueError):
        V.distance("l1", p, h)


def test_budgets():
    assert [budgets.refine_candidates(n) for n in (10, 50, 100, 125)] == [10, 11, 13, 14]
    assert budgets.pq_chunk_bounds(7, 3) == [0, 3, 5, 7]
    with pytest.raises(ValueError):
        budgets.pq_chunk_bounds(4, 5)


def test_exact_and_graph_search(spark, tmp_path):
    rows = smooth()
    base = spark.createDataFrame(rows, "id long, vec array<double>")
    qs = base.where(F.col("id").isin(0, 37, 91, 173, 299)).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    x = np.array([r[1] for r in rows])
    want = {q: sorted(range(300), key=lambda i: (round(((x[i] - x[q]) ** 2).sum(), 12), i))[:5] for q in (0, 37, 91, 173, 299)}
    index = I.build_index(base, str(tmp_path / "index"), degree=12)
    for found in (S.exact_topk(qs, base, 5), index.search(qs, 5, size=64)):
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want
    assert S.exact_topk(qs, base.limit(0), 5).count() == 0


def test_index_of_many_shards(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.array("label").alias("labels"))
    e = e.unionByName(spark.createDataFrame([(10_000, None, [1]), (10_001, None, None)], "id long, vec array<double>, labels array<int>"))
    same = [(20_000 + i, [1.0] + [0.0] * 63, [7]) for i in range(300)]  # more equal rows than a shard holds
    e = e.unionByName(spark.createDataFrame(same, "id long, vec array<double>, labels array<int>"))
    built = I.build_index(e, str(tmp_path / "i"), capacity=128)
    index = I.open_index(spark, str(tmp_path / "i"))
    assert index.probes == built.probes and index.nodes.select("id").distinct().count() == 800
    assert index.nodes.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200
    q = e.where("id % 20 = 0 and vec is not null").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    truth = S.exact_topk(q, e, 20).withColumn("distance", F.round("distance", 9))
    assert R.recall_at_k(index.search(q, 10), truth, 10).agg(F.avg("recall")).first()[0] >= 90
    with pytest.raises(ValueError):
        index.search(q, 10, size=5)
    spark.createDataFrame([(1,)], "x long").write.mode("append").parquet(str(tmp_path / "i" / "nodes"))
    with pytest.raises(ValueError):
        I.open_index(spark, str(tmp_path / "i"))
    empty = I.build_index(e.limit(0), str(tmp_path / "e"))
    assert empty.nodes.count() == 0 and empty.search(q, 10).count() == 0


def test_walk_of_a_label_stays_in_its_rows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.array("label").alias("labels"))
    wanted = e.where(F.array_contains("labels", 3))
    q = e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    truth = S.exact_topk(q, wanted, 20).withColumn("distance", F.round("distance", 9))
    for capacity in (128, 4096):
        index = I.build_index(e, str(tmp_path / str(capacity)), capacity=capacity)
        found = index.search(q, 10, label=3, probes=index.cells.count())
        assert found.join(wanted, "id", "left_anti").count() == 0
        assert R.recall_at_k(found, truth, 10).agg(F.avg("recall")).first()[0] >= 95
        assert found.agg(F.max("work")).first()[0] <= 2 * wanted.count() / (1 + (capacity == 4096))  # a row is in two shards


def test_near_graph_of_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(500, 16)), np.ones((60, 16)), np.zeros((3, 16))])
    rows = [(3 * i, v.tolist()) for i, v in enumerate(x)]
    base = spark.createDataFrame([*rows, rows[7], (9_999, None)], "id long, vec array<double>")
    want = {}
    for i, v in enumerate(x):
        d = np.cumsum((x - v) * (x - v), axis=1)[:, -1].tolist()  # in the order of the coordinates
        want[3 * i] = [(3 * j, d[j]) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], j))[:8]]
    for block in (100, 4096):
        got = {}
        for r in I.near_graph(base, 8, block).orderBy("src", "pos").collect():
            got.setdefault(r.src, []).append((r.dst, r.distance))
        assert got == want
    assert I.near_graph(base.limit(0), 8).count() == 0
    assert {(r.src, r.dst) for r in I.near_graph(base.where("id < 9"), 8, 1).collect()} == {(i, j) for i in (0, 3, 6) for j in (0, 3, 6) if i != j}


def test_bfs_query_reaches_all_levels(spark, tmp_path):
    from vecspark.plans import QUERIES

    rows = [(i, [float(i), 0.0], 0) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ahead = {i: sorted((j for j in range(90) if j != i), key=lambda j: (abs(i - j), j))[:8] for i in range(90)}
    level, frontier = {0: 0}, [0]
    while frontier:
        frontier = sorted({j for i in frontier for j in ahead[i]} - level.keys())
        level |= dict.fromkeys(frontier, max(level.values()) + 1)
    got = {r.level: r.n for r in QUERIES["a35_g31_bfs_levels"](spark, str(tmp_path)).collect()}
    assert max(got) > 7 and got == {n: list(level.values()).count(n) for n in set(level.values())}


def test_noisy_or_and_importance(spark):
    e = spark.createDataFrame([(1, 5, 0.5), (1, 5, 0.5), (2, 5, 1.0), (1, 6, 0.0)], "source_id long, witness_id long, credit double")
    s = R.noisy_or(e)
    assert {(r.source_id, r.witness_id): round(r.saturation, 9) for r in s.collect()} == {(1, 5): 0.75, (2, 5): 1.0, (1, 6): 0.0}
    i = {r.id: r for r in R.node_importance(s, spark.createDataFrame([(5,), (6,), (7,)], "id long")).collect()}
    assert i[5].raw == 1.75 and i[5].source_support == 2 and i[5].percentile == 1 and i[7].raw == 0
    none = R.node_importance(s.limit(0), spark.createDataFrame([(7,)], "id long")).first()
    assert none.percentile == 0


def test_coaccess_golden(spark):
    t = spark.createDataFrame([(0, 5, 0), (0, 6, 2), (0, 7, 3), (1, 5, 0), (1, 6, 2)], "query_id long, hop long, node_id long")
    assert {(r.node_a, r.node_b): r.together for r in R.coaccess(t, 8, 5).collect()} == {(0, 2): 2, (0, 3): 1, (2, 3): 1}


def test_partitions(spark):
    base = spark.createDataFrame(smooth(), "id long, vec array<double>")
    sizes = [r["count"] for r in P.balanced_partition(base, 8).groupBy("part").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 40
    cells = P.recursive_cells(base, 32)
    assert cells.select("id").distinct().count() == cells.count() == 300
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 32
    triangles = spark.createDataFrame([(1, 2, 4), (2, 3, 4), (1, 3, 4), (4, 5, 4), (5, 6, 4), (4, 6, 4)], "a long, b long, weight long")
    label = P.label_communities(triangles)
    assert {r.id: r.community for r in label.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert R.modularity(triangles, label).first()[0] == pytest.approx(0.5)


def _modularity(pairs, own):
    m, inside, total = sum(w for _, _, w in pairs), {}, {}
    for a, b, w in pairs:
        inside[own[a]] = inside.get(own[a], 0) + w * (own[a] == own[b])
        for x in (a, b):
            total[own[x]] = total.get(own[x], 0) + w
    return sum(inside.values()) / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_louvain_query_has_no_gain_left(spark, tmp_path):
    from vecspark.plans import QUERIES

    x = np.random.default_rng(5).normal(size=(160, 4))
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(np.float32).astype(float)
    near = {i: [j for j in sorted(range(160), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j)) if j != i][:8] for i in range(160)}
    pairs = [(a, b, (b in near[a]) + (a in near[b])) for a in range(160) for b in range(a + 1, 160) if b in near[a] or a in near[b]]
    own = {r.id: r.community for r in QUERIES["a27_louvain_communities"](spark, str(tmp_path)).collect()}
    assert own.keys() == set(range(160)) and all(own[c] == c == min(i for i in own if own[i] == c) for c in own.values())
    q, groups = _modularity(pairs, own), set(own.values())
    assert q > 0.4 and all(_modularity(pairs, {i: b if c == a else c for i, c in own.items()}) <= q + 1e-9 for a in groups for b in groups if a < b)


def test_gateways_apart_in_direction(spark):
    near = [(0, 3, [1.0, 0.0]), (1, 9, [0.9, 0.1 ** 0.5]), (2, 5, [0.0, 1.0]), (3, 8, None), (4, 2, [-1.0, 0.0]), (5, 7, [0.0, 1.0])]
    rows = [(1, 2, o, 100 + t, t, v) for o, t, v in near] + [(2, 1, 0, 4, 6, None), (2, 1, 1, 4, 1, [1.0, 0.0])]
    c = spark.createDataFrame(rows, "source_community long, target_community long, ordinal long, source_node long, target_node long, direction array<double>")
    got = {}
    for r in R.select_gateways(c, 4).orderBy("source_community", "ordinal").collect():
        assert r.ordinal == len(got.setdefault(r.source_community, [])) and r.source_node in (4, 100 + r.target_node)
        got[r.source_community].append(r.target_node)
    assert got == {1: [3, 2, 5, 9], 2: [6, 1]}


def test_gateway_selection_query(spark):
    from vecspark.plans import QUERIES

    d = "/root/testdata/sf0.001"
    n = {(r[0], r[1]): r[2] for r in QUERIES["a21_j20_cross_edges"](spark, d).select("source_community", "target_community", "targets").collect()}
    got = QUERIES["w6_gateway_selection"](spark, d).groupBy("source_community", "target_community").agg(F.countDistinct("target_node"), F.max("ordinal")).collect()
    assert {(r[0], r[1]): (r[2], r[3] + 1) for r in got} == {k: (min(8, v), min(8, v)) for k, v in n.items()}


def test_changes_and_sources(spark, tmp_path):
    log = spark.createDataFrame([(7, 1, "insert"), (7, 2, "delete"), (8, 3, "insert"), (0, 4, "insert"), (None, 5, "insert")], "tag long, seq long, op string")
    assert [r.tag for r in R.live_rows(log).collect()] == [8]
    assert {r.tag: r.op for r in apply_changes(log.limit(0), log).collect()} == {7: "delete", 8: "insert"}
    (tmp_path / "a.bin").write_bytes(bin_bytes([[1, 2], [3, 4]]))
    assert [(r.id, r.vec) for r in read_bin(spark, str(tmp_path / "a.bin")).orderBy("id").collect()] == [(0, [1, 2]), (1, [3, 4])]
    with pytest.raises(ValueError):
        require_columns(log, tag="string")


def test_sources_refuse_what_is_wrong(spark, tmp_path):
    from vecspark import sources as X

    e = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, vec array<double>")
    X.save_vecs(e, f"{tmp_path}/a.fvecs")
    assert [(r.id, r.vec) for r in X.read_vecs(spark, f"{tmp_path}/a.fvecs").orderBy("id").collect()] == [(0, [1, 2]), (1, [3, 4])]
    assert X.fnv1a(b"") == 0xCBF29CE484222325 and X.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert [tuple(r) for r in X.checksums(spark.createDataFrame([("a",), (None,)], "t string"), "t").select("fnv1a", "crc32").collect()] == [("af63dc4c8601ec8c", 0xE8B7BE43), (None, None)]
    t = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 8, 0.75)], "qid long, rank long, id long, distance double")
    X.save_truth(t, f"{tmp_path}/t", 2)
    assert [tuple(r) for r in X.load_truth(spark, f"{tmp_path}/t").collect()] == [tuple(r) for r in t.collect()]
    X.save_truth(t, f"{tmp_path}/u", 2, distances=False)
    assert [r.distance for r in X.load_truth(spark, f"{tmp_path}/u").collect()] == [None, None]
    with pytest.raises(ValueError):
        X.save_truth(t, f"{tmp_path}/v", 3)
    (tmp_path / "w").write_bytes((tmp_path / "t").read_bytes()[:-1])
    with pytest.raises(ValueError):
        X.load_truth(spark, f"{tmp_path}/w")
    X.save_csv(t, f"{tmp_path}/csv", ["qid", "rank"])
    assert X.load_csv(spark, f"{tmp_path}/csv", "qid long, rank long, id long, distance double").count() == 2
    with pytest.raises(ValueError):
        X.load_csv(spark, f"{tmp_path}/csv", "qid long, id long")
    tags = spark.createDataFrame([(0, 5), (1, 6)], "id long, tag long")
    assert X.load_tags(tags, e).count() == 2
    for bad in ([(0, 5)], [(0, 5), (1, 5)], [(0, 5), (2, 6)]):
        with pytest.raises(ValueError):
            X.load_tags(spark.createDataFrame(bad, "id long, tag long"), e)
    assert X.folder_bytes(spark, f"{tmp_path}/t") == 8 + 8 * 2


def test_rules(spark):
    x = lambda c: one(spark, c)
    assert [budgets.guard_allows(*a) for a in ((0, 0.5, 0), (10, 0.25, 6), (10, 0.25, 7), (10, 2.0, 0))] == [False, True, False, False]
    assert x(V.relative_increase(F.lit(0), F.lit(0))) == 0 and x(V.relative_increase(F.lit(3), F.lit(0))) == float("inf") and x(V.relative_increase(F.lit(3), F.lit(2))) == 0.5
    null = F.lit(None).cast("double")
    assert x(V.is_mature(F.lit(2), F.lit(1.0), null, 2, 1.0)) and not x(V.is_mature(F.lit(2), F.lit(1.1), F.lit(1.0), 2, 1.0)) and not x(V.is_mature(F.lit(2), null, null, 2, 1.0))
    assert x(V.first_failure([("a", F.lit(True)), ("b", null.cast("boolean")), ("c", F.lit(False))])) == "b"
    kind, number = V.chunk_parts(V.chunk_id(F.lit(3), F.lit(77).cast("long")))
    assert (x(kind), x(number)) == (3, 77)
    pairs = spark.createDataFrame([(1, 2, 5), (2, 3, 9), (3, 4, 5), (5, 6, 1), (4, 7, 5)], "a long, b long, n long")
    assert sorted(tuple(r) for r in R.disjoint_pairs(pairs, "n").collect()) == [(2, 3, 9), (4, 7, 5), (5, 6, 1)]
    assert R.disjoint_pairs(pairs.limit(0), "n").count() == 0
    mass = spark.createDataFrame([(1, 0.95), (3, 1.0), (2, 0.05), (4, 0.0)], "id long, mass double")
    assert {r.id for r in R.importance_mass(mass, 0.7).collect()} == {3, 1} and R.importance_mass(mass.where("id = 4"), 0.7).count() == 0
    with pytest.raises(ValueError):
        R.label_ids(spark.createDataFrame([("x",)], "raw string"), spark.createDataFrame([("y", 1)], "raw string, label int"))
    with pytest.raises(ValueError):
        R.require_disjoint(spark.createDataFrame([(1, "a"), (1, "b")], "q long, s string"), "q", "s")
    shuffled = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "id long")
    assert all(r.n == r.id for r in R.numbered(shuffled, "id", "n").collect())


def test_quantisers(spark):
    from vecspark.operators import pq as Q

    p = np.arange(256.0)
    x = np.stack((p, p * 7 % 31, np.sin(p / 10), np.cos(p / 10)), axis=1)
    book = Q.train_codebook(x, 2)
    codes = Q.encode(book, x)
    assert book.shape == (2, 256, 2) and codes.shape == (256, 2) and ((Q.decode(book, codes) - x) ** 2).mean() < 0.05
    with pytest.raises(ValueError):
        Q.train_codebook(x, 3)
    chunk, code = np.arange(64), np.arange(256)
    table = (17 * chunk[:, None] + 3 * code[None]) % 101 * 0.25
    own = (29 * np.arange(13)[:, None] + 7 * chunk[None]) % 256
    whole, step, low = Q.quantized(table[None], 16)
    near = whole[0][chunk, own].sum(1) * step[0] + low[0].sum()
    assert np.abs(near - table[chunk, own].sum(1)).max() <= 64 * step[0] / 2


def test_change_streams(spark, tmp_path):
    from vecspark.streaming import start_upserts, windowed_changes

    schema = "tag long, seq long, op string, ts timestamp"
    log = spark.sql("select id % 5 as tag, id as seq, if(id % 4 = 3, 'delete', 'insert') as op, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts from range(60)").coalesce(1)
    for lo in range(0, 60, 20):
        log.where(f"seq >= {lo} and seq < {lo + 20}").write.mode("append").parquet(f"{tmp_path}/log")
    state = {"table": log.limit(0).select("tag", "seq", "op")}

    def write(table, n):
        rows = table.collect()
        state["table"] = spark.createDataFrame(rows, "tag long, seq long, op string")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    q = start_upserts(stream, lambda: state["table"], write, f"{tmp_path}/check", None)
    q.awaitTermination(120)
    assert sorted(map(tuple, state["table"].collect())) == sorted(map(tuple, apply_changes(log.limit(0), log).collect()))
    w = windowed_changes(stream, width="30 minutes").writeStream.format("memory").queryName("changes").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    got = spark.table("changes").groupBy("op").agg(F.sum("n").alias("n")).collect()
    assert {r.op: r.n for r in got} == {"insert": 45, "delete": 15}


def plain_prune(point, nodes, degree, alpha):
    """Pruning as it is defined, one comparison at a time: (kept ids, {victim: (witness, alternative)})."""
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pool = sorted((d(point, v), i, v, gone) for i, v, gone in nodes)
    passed, kept, slack = [], [], 1.0

    def worst(n):
        ratios = [(np.inf if d(p[2], n[2]) == 0 else n[0] / d(p[2], n[2]), -p[1]) for p in passed if (p[0], p[1]) < (n[0], n[1])]
        return max(ratios, default=(0, 0))

    while slack <= alpha + 1e-9:
        for n in pool:
            if n not in passed and len(kept) < degree and worst(n)[0] <= slack:
                passed.append(n)
                kept += [] if n[3] else [n]
        slack *= 1.2
    events = {}
    for n in pool:
        f, w = worst(n)
        if n not in passed and not n[3] and f > alpha:
            events[n[1]] = (-w, min((d(k[2], n[2]), k[1]) for k in kept if k[1] != -w)[1] if any(k[1] != -w for k in kept) else -1)
    return [k[1] for k in kept], events


@pytest.mark.parametrize("seed", range(6))
def test_prune_events_against_plain_pruning(seed):
    """Ties, equal vectors and deleted rows are among the candidates."""
    rng = np.random.default_rng(seed)
    vec = rng.integers(0, 4, (30, 3)).astype(float)
    ids, gone, point = rng.permutation(30).astype(np.int64) + 100, rng.random(30) < 0.2, rng.integers(0, 4, 3).astype(float)
    log = []
    kept = S.robust_prune(ids, vec, point, 4, 1.2, 30, deleted=gone, events=log)
    want, events = plain_prune(point.tolist(), [(int(i), v.tolist(), bool(g)) for i, v, g in zip(ids, vec, gone, strict=True)], 4, 1.2)
    assert [int(ids[k]) for k in kept] == want
    assert {int(ids[v]): (int(ids[w]), -1 if a < 0 else int(ids[a])) for w, v, a in log} == events and len(log) == len(events)


def test_pruned_lists(spark):
    """Repeated edges count once; ends without a row, null vectors and empty graphs are left out."""
    base = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.5]), (4, None)], "id long, vec array<double>")
    edges = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (0, 3), (0, 4), (0, 9), (4, 1)], "src long, dst long")
    (row,) = S.pruned(edges, base, 4).collect()
    assert (row.src, row.neighbours) == (0, [1, 3])
    assert [tuple(e) for e in row.events] == [(1, 2, 4.0, 1.0, 6.25)]
    (row,) = S.pruned(edges, base, 4, deleted=spark.createDataFrame([(1,)], "id long")).collect()
    assert row.neighbours == [3] and [e.victim_id for e in row.events] == [2]
    assert S.pruned(edges.where("src < 0"), base, 4).count() == 0


def test_beam_grows_past_the_marker():
    assert [budgets.next_beam(4, 8, u, h, 4, 8, 0.25) for u, h in ((8, 5), (8, 4), (6, 5), (4, 5))] == [5, 4, 5, 4]
    assert budgets.next_beam(8, 8, 8, 9, 4, 8) == 8 and budgets.next_beam(2, 0, 0, 9, 4, 8) == 2
    with pytest.raises(ValueError):
        budgets.next_beam(1, 2, 3, 0, 4, 8)
