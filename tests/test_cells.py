"""Cell builders, placement, caches, mappings and the layered index against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import cells as C
from vecspark.operators import layered as L
from vecspark.operators import relational as R
from vecspark.operators import search as S


def test_packs_start_anew_when_full(spark):
    rows = [(0, 1, 9), (0, 2, 7), (0, 3, 1), (0, 4, 40), (0, 5, 2), (1, 9, 3)]
    got = C.pack_cells(spark.createDataFrame(rows, "g long, c long, n long"), "g", "c", "n", 16).collect()
    assert {(r.g, r.c): r.pack for r in got} == {(0, 1): 0, (0, 2): 0, (0, 3): 1, (0, 4): 2, (0, 5): 3, (1, 9): 0}


@pytest.mark.parametrize("capacity", [1, 2, 5])
def test_cache_replay(spark, capacity):
    rng = np.random.default_rng(capacity)
    rows = [(int(k), at, int(p)) for k in range(5) for at, p in enumerate(rng.integers(0, 7, 60))]
    got = {r.k: (r.accesses, r.hits, r.misses, r.evictions) for r in C.lru_replay(spark.createDataFrame(rows, "k long, at long, page long").repartition(3), "k", ["at"], "page", capacity).collect()}
    for k in range(5):
        cache, hits, gone = [], 0, 0
        for _, _, p in (r for r in rows if r[0] == k):
            hits += p in cache
            cache = [x for x in cache if x != p] + [p]
            gone += len(cache) > capacity
            cache = cache[-capacity:]
        assert got[k] == (60, hits, 60 - hits, gone)
    empty = spark.createDataFrame([], "k long, at long, page long")
    assert C.lru_replay(empty, "k", ["at"], "page", capacity).count() == 0
    with pytest.raises(ValueError):
        C.lru_replay(empty, "k", ["at"], "page", 0)


def test_assignments_are_checked(spark):
    nodes = spark.range(4)
    schema = "node_id long, community_id long, cell_id long, `order` long"
    good = [(0, 0, 0, 1), (1, 0, 0, 0), (2, 1, 1, 0), (3, 1, 1, 1)]
    assert C.assigned_cells(nodes, spark.createDataFrame(good, schema), 2).count() == 4
    wrong = [good[:3], good + [(3, 1, 2, 0)], good + [(9, 1, 2, 0)], [(0, 0, 0, 1), (1, 1, 0, 0), *good[2:]], [(0, 0, 0, 1), (1, 0, 0, 1), *good[2:]], [(0, 0, 0, 2), (1, 0, 0, 1), *good[2:]]]
    for rows in wrong:
        with pytest.raises(ValueError):
            C.assigned_cells(nodes, spark.createDataFrame(rows, schema), 2)
    with pytest.raises(ValueError):
        C.assigned_cells(nodes, spark.createDataFrame(good, schema), 1)


def test_cells_start_pages(spark):
    rows = [(0, k, 100 + k) for k in range(5)] + [(7, 0, 3)] + [(9, k, 10 + k) for k in range(4)]
    got = {r.id: (r.page, r.slot) for r in C.cell_pages(spark.createDataFrame(rows, "cell_id long, `order` long, id long"), 4).collect()}
    assert got == {100: (0, 0), 101: (0, 1), 102: (0, 2), 103: (0, 3), 104: (1, 0), 3: (2, 0), 10: (3, 0), 11: (3, 1), 12: (3, 2), 13: (3, 3)}


def test_placement_takes_the_most_linked(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 24, (120, 2)) if a != b}
    members = [(i, i % 2) for i in range(24)]
    got = C.place_by_links(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(members, "id long, cell long"), 3).collect()
    for cell in (0, 1):
        left, order = [i for i, c in members if c == cell], []
        while left:
            score = {i: sum(((p, i) in edges) + ((i, p) in edges) + 2 * ((p, i) in edges and (i, p) in edges) for p in order[-3:]) for i in left}
            best = min(left, key=lambda i: (-score[i], i))
            order.append(best)
            left.remove(best)
        assert [r.id for r in sorted((r for r in got if r.cell == cell), key=lambda r: r.place)] == order


def test_coaccess_cells_golden(spark):
    rows = [(0, 0, 0, 5), (0, 0, 2, 6), (0, 1, 3, 7), (1, 0, 0, 5), (1, 0, 2, 6)]
    trace = spark.createDataFrame(rows, "query_id long, community long, node_id long, hop long")
    together = R.coaccess(trace, 8, 5)
    members = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 2)], "id long, community long, source_cell long")
    visits = trace.groupBy("node_id").agg(F.count("*").alias("visit_count"))
    got = {r.id: (r.community, r.cell, r.order) for r in C.coaccess_cells(together, visits, members, 2).collect()}
    assert got[0][:2] == got[2][:2] != got[3][:2] and (got[0][2], got[2][2]) == (0, 1)
    assert sorted(got) == [0, 1, 2, 3] and got[1][:2] != got[0][:2]


def test_locality_keys_put_equal_codes_together(spark):
    rng = np.random.default_rng(2)
    book = rng.normal(size=(4, 16, 3))
    ranks = C.principal_ranks(book)
    assert all(sorted(r) == list(range(16)) for r in ranks)
    codes = rng.integers(0, 16, (50, 4))
    keys = C.locality_keys(codes, book, 4)
    for k, row in zip(keys, codes, strict=True):
        level = [int(ranks[c][row[c]]) * 256 // 16 for c in range(4)]  # 8 bits each
        assert k == sum(((level[c] >> b) & 1) << (b * 4 + c) for c in range(4) for b in range(8))
    coded = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "id long, codes array<long>")
    got = sorted((r.cell_id, r.order, r.id) for r in C.locality_cells(coded, book, 8, 4).collect())
    assert [i for _, _, i in got] == sorted(range(50), key=lambda i: (keys[i], i))
    assert [c for c, _, _ in got] == [i // 8 for i in range(50)]


def test_start_points(spark):
    p = C.sphere_points(spark, 200, 8, 2.5, 3).orderBy("id").collect()
    x = np.array([r.vec for r in p])
    assert np.allclose(np.linalg.norm(x, axis=1), 2.5) and np.abs(x.mean(0)).max() < 0.4 and all(r.is_frozen for r in p)
    assert x.tolist() == [r.vec for r in C.sphere_points(spark, 200, 8, 2.5, 3).orderBy("id").collect()]
    assert x.tolist() != [r.vec for r in C.sphere_points(spark, 200, 8, 2.5, 4).orderBy("id").collect()]


def test_mappings_are_published_once(spark, tmp_path):
    path = str(tmp_path / "mapping")
    now = spark.createDataFrame([(i, i) for i in range(6)], "cell long, target long")
    first = C.merged_mapping(now, spark.createDataFrame([(0, 1), (4, 5)], "a long, b long"))
    assert C.current_generation(spark, path) == 0 and C.publish_mapping(first, path, 0) == 1
    with pytest.raises(ValueError):
        C.publish_mapping(now, path, 0)
    second = C.merged_mapping(spark.read.parquet(f"{path}/generation=1"), spark.createDataFrame([(0, 4)], "a long, b long"))
    assert C.publish_mapping(second, path, 1) == 2 == C.current_generation(spark, path)
    assert {r.cell: r.target for r in spark.read.parquet(f"{path}/generation=2").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 0}


@pytest.mark.parametrize("capacity", [4096, 60])
def test_layered_search(spark, tmp_path, capacity):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(240, 6)))] + [(500, None)]
    base = spark.createDataFrame([*rows, rows[3]], "id long, vec array<double>")
    index = L.build_layers(base, str(tmp_path / "layers"), capacity)
    assert index.count() == 240 and (index.select("shard").distinct().count() > 1) == (capacity == 60)
    queries = base.where("id % 20 = 0 and vec is not null").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found, truth = L.layered_topk(queries, index, 5), S.exact_topk(queries, base.dropDuplicates(["id"]), 5)
    both = found.join(truth.select("qid", "id"), ["qid", "id"], "left_semi").count()
    assert found.count() == 5 * queries.count() and both >= 0.95 * truth.count()
    layers = Counter(r.layer for r in index.select("layer").collect())
    assert layers[0] > 200 and all(len(r.links) == r.layer + 1 for r in index.collect())


def test_layered_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    index = L.build_layers(empty, str(tmp_path / "none"))
    assert index.count() == 0
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, qvec array<double>")
    assert L.layered_topk(queries, index, 3).count() == 0


def test_route_profile(spark):
    vec = {0: 0.0, 1: 0.1, 2: 5.0, 3: 0.2, 4: 5.1}
    rows = spark.createDataFrame([(i, [v]) for i, v in vec.items()], "id long, vec array<double>")
    buckets = spark.createDataFrame([(0, [0.0]), (1, [5.0])], "center long, cvec array<double>")
    hits = spark.createDataFrame([(0, 7), (0, 7), (1, 8), (1, 7), (2, 9), (3, 1)], "query_id long, cell long")
    got = C.route_profile(rows.where("id > 2"), rows.where("id <= 2"), hits, buckets, 1).collect()
    assert sorted((r.query_id, r.rank, r.cell) for r in got) == [(3, 1, 7), (4, 1, 9)]
