"""Nearest neighbours: exact in blocks, and the pruned proximity graphs that an index walks.

Base vectors are never all in one place. Queries are a stated set: they go to the tasks as one
matrix when their size is under QUERY_BYTES, and otherwise block by block. A task keeps its k best of
each query, so what is shuffled is k rows a query and task.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Bytes of query vectors in one block.
QUERY_BYTES = 32 << 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def pairwise(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of queries (rows) and vectors (columns)."""
    dots = q @ x.T
    if metric == "ip":
        return -dots
    if metric == "cosine":
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
        return np.where(norms > 0, 1 - dots / np.where(norms > 0, norms, 1), np.inf)
    if metric == "fast_l2":
        return (x * x).sum(1)[None] - 2 * dots
    if metric == "l2":
        return np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * dots)
    raise ValueError(f"unknown metric {metric!r}")


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of the k least of each row, ties to the smaller id."""
    if dist.shape[1] > k:
        bound = np.partition(dist, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(dist <= bound[:, None])
    else:
        rows, cols = np.nonzero(np.isfinite(dist))
    order = np.lexsort((ids[cols], dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    keep = (nth < k) & np.isfinite(dist[rows, cols])
    return rows[keep], cols[keep]


def nearest_others(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, distance) of the k nearest vectors of each query but those with its own id; ties to the smaller id.

    Products find the candidates, with room for their rounding; the squared distances are summed in the order of the
    coordinates, as SQL does, so that equal ones tie. About `cells` pairs are in memory at a time.
    """
    out, step = [], max(1, cells // max(1, len(ids)))
    norms, qt, xt = (x * x).sum(1), np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
    few = max(k + 1, len(ids) // 8)  # enough for a bound that leaves out nearly all
    for lo in range(0, len(qids) if len(ids) else 0, step):
        hi = min(len(qids), lo + step)
        dist = pairwise("l2", q[lo:hi], x)
        dist[qids[lo:hi, None] == ids[None]] = np.inf
        r, c = np.nonzero(np.isfinite(dist))
        if len(ids) > k:
            room = 1e-12 * ((q[lo:hi] * q[lo:hi]).sum(1) + norms.max())
            r, c = np.nonzero(dist <= (np.partition(dist[:, :few], k - 1, axis=1)[:, k - 1] + room)[:, None])
        exact = np.zeros(len(r))
        for a, b in zip(qt, xt, strict=True):
            exact += (a[lo + r] - b[c]) ** 2
        exact[qids[lo + r] == ids[c]] = np.inf
        order = np.lexsort((ids[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = (np.arange(len(r)) - np.searchsorted(r, r, "left") < k) & np.isfinite(exact)
        out.append((qids[lo + r[keep]], ids[c[keep]], exact[keep]))
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(part) for part in zip(none, *out, strict=True))


def rank_per_query(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, distance): the k best rows of each query by (distance, id)."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def by_query_blocks(queries: DataFrame, search: Callable[[np.ndarray, np.ndarray], DataFrame], limit: int = QUERY_BYTES) -> DataFrame:
    """The union of search(qids, matrix) over blocks of queries (qid, qvec) of at most about `limit` bytes.

    One block is searched lazily. Of several, each one's rows are written before the next block is fetched, so the
    driver holds one block at a time. Queries without a vector are left out.
    """
    queries = queries.where("qvec is not null").select("qid", "qvec")
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    blocks = max(1, -(-n * max(1, dim) * 8 // limit))
    block, parts = F.pmod(F.xxhash64("qid"), F.lit(blocks)), []
    for b in range(blocks):
        rows = (queries if blocks == 1 else queries.where(block == b)).toPandas()
        found = search(rows["qid"].to_numpy(np.int64), _matrix(rows["qvec"]))
        parts.append(found if blocks == 1 else cut(found))
    return reduce(DataFrame.unionByName, parts)


def exact_topk(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, rank, id, distance) of queries (qid, qvec) over base (id, vec), by brute force.

    Null vectors are left out; ids break ties. Fewer than k base rows give fewer rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = base.where("vec is not null").select("id", "vec")

    def search(qids: np.ndarray, q: np.ndarray) -> DataFrame:
        shared = base.sparkSession.sparkContext.broadcast((qids, q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            for batch in batches:
                if len(batch) and len(qids):
                    ids = batch["id"].to_numpy()
                    dist = pairwise(metric, q, _matrix(batch["vec"]))
                    if exclude_self:
                        dist[qids[:, None] == ids[None]] = np.inf
                    r, c = _best(dist, ids, k)
                    yield pd.DataFrame({"qid": qids[r], "id": ids[c], "distance": dist[r, c]})

        return rows.mapInPandas(run, "qid long, id long, distance double")

    return rank_per_query(by_query_blocks(queries, search), k)


def range_search(queries: DataFrame, base: DataFrame, radius: float) -> DataFrame:
    """(qid, id, distance) within a squared radius; queries come in blocks, as in exact_topk."""
    rows = base.where("vec is not null").select("id", "vec")

    def search(qids: np.ndarray, q: np.ndarray) -> DataFrame:
        shared = base.sparkSession.sparkContext.broadcast((qids, q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            for batch in batches:
                if len(batch) and len(qids):
                    dist = pairwise("l2", q, _matrix(batch["vec"]))
                    r, c = np.nonzero(dist <= radius)
                    yield pd.DataFrame({"qid": qids[r], "id": batch["id"].to_numpy()[c], "distance": dist[r, c]})

        return rows.mapInPandas(run, "qid long, id long, distance double")

    return by_query_blocks(queries, search)


def entry_of(vec: np.ndarray) -> int:
    """The row nearest to the mean; the first of equal ones."""
    return int(np.argmin(((vec - vec.mean(0)) ** 2).sum(1)))


def robust_prune(ids: np.ndarray, vec: np.ndarray, point: np.ndarray, degree: int, alpha: float = 1.2, pool: int = 750, saturate: bool = False, deleted: np.ndarray | None = None, events: list | None = None) -> list[int]:
    """Neighbours that no closer kept one occludes: positions into ids.

    A candidate is occluded at slack a when its squared distance to the point exceeds a times that to a
    kept neighbour. a grows from 1 by 1.2 up to alpha.
    deleted: which candidates occlude others but are never returned.
    events: takes (witness, victim, alternative) of the live candidates left out that are occluded at alpha. The witness
    is what occludes most (then the smaller id), the alternative the nearest other neighbour returned, or -1.
    """
    to_point = ((vec - point) ** 2).sum(1)
    order = np.lexsort((ids, to_point))[:pool]
    factor, by, kept, slack = np.zeros(len(order)), np.full(len(order), -1), [], 1.0
    while slack <= alpha + 1e-9 and len(kept) < degree:
        for i, c in enumerate(order):
            if len(kept) >= degree:
                break
            if factor[i] > slack or factor[i] < 0:
                continue
            factor[i] = -1  # passed
            if deleted is None or not deleted[c]:
                kept.append(int(c))
            later = order[i + 1 :]
            between = ((vec[later] - vec[c]) ** 2).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(between == 0, np.inf, to_point[later] / between)
            open_ = factor[i + 1 :] >= 0
            more = open_ & ((ratio > factor[i + 1 :]) | ((ratio == factor[i + 1 :]) & (ids[c] < ids[by[i + 1 :]])))
            factor[i + 1 :][more], by[i + 1 :][more] = ratio[more], c
        slack *= 1.2
    if events is not None:
        for i in np.flatnonzero(factor > alpha):
            v, others = int(order[i]), [k for k in kept if k != by[i]]
            if deleted is None or not deleted[v]:
                best = min(others, key=lambda k: (((vec[k] - vec[v]) ** 2).sum(), ids[k]), default=-1)
                events.append((int(by[i]), v, best))
    if saturate and alpha > 1:
        kept += [int(c) for c in order if int(c) not in set(kept) and (deleted is None or not deleted[c])][: degree - len(kept)]
    return kept


def pruned(edges: DataFrame, base: DataFrame, degree: int, alpha: float = 1.2, deleted: DataFrame | None = None) -> DataFrame:
    """(src, neighbours, events) of the rows of a graph (src, dst), pruned to a smaller degree in one pass.

    events: (witness_id, victim_id, d_sv, d_wv, d_av) with squared distances. deleted: (id) of rows that are no
    neighbours any more. One list of a graph, bounded by its degree, is in memory at a time; sources without a vector go.
    """
    gone = F.lit(False) if deleted is None else F.col("gone").isNotNull()
    ends = base.where("vec is not null").select("id", "vec")
    marked = ends.withColumn("gone", F.lit(None)) if deleted is None else ends.join(deleted.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    marked = marked.select(F.col("id").alias("dst"), F.struct("id", "vec", gone.alias("gone")).alias("node"))
    lists = edges.select("src", "dst").distinct().join(marked, "dst").groupBy("src").agg(F.collect_list("node").alias("nodes"))
    rows = lists.join(ends.select(F.col("id").alias("src"), F.col("vec").alias("point")), "src")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept, seen = [], []
            for nodes, point in zip(b["nodes"], b["point"], strict=True):
                ids, vec = np.array([n["id"] for n in nodes], np.int64), np.array([n["vec"] for n in nodes], np.float64)
                point, log = np.asarray(point, np.float64), []
                gone = np.array([n["gone"] for n in nodes], bool)
                kept.append([int(ids[k]) for k in robust_prune(ids, vec, point, degree, alpha, len(ids), deleted=gone, events=log)])
                apart = lambda a, c: float(((a - c) ** 2).sum())
                seen.append([{"witness_id": int(ids[w]), "victim_id": int(ids[v]), "d_sv": apart(point, vec[v]), "d_wv": apart(vec[w], vec[v]), "d_av": None if a < 0 else apart(vec[a], vec[v])} for w, v, a in log])
            yield pd.DataFrame({"src": b["src"], "neighbours": kept, "events": seen})

    return rows.mapInPandas(run, "src long, neighbours array<long>, events array<struct<witness_id: long, victim_id: long, d_sv: double, d_wv: double, d_av: double>>")


def build_graph(ids: np.ndarray, vec: np.ndarray, degree: int = 16, pool: int = 48, alpha: float = 1.2) -> list[np.ndarray]:
    """A pruned proximity graph in synchronous rounds: near pools, pruning, reverse edges, pruning."""
    n = len(ids)
    lists: list[np.ndarray] = []
    for lo in range(0, n, 512):
        dist = pairwise("l2", vec[lo : lo + 512], vec)
        dist[np.arange(len(dist)), np.arange(lo, lo + len(dist))] = np.inf
        near = np.argsort(dist, axis=1, kind="stable")[:, : min(pool, n - 1)]
        for row, c in enumerate(near):
            lists.append(c[robust_prune(ids[c], vec[c], vec[lo + row], degree, alpha, pool)])
    reverse: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(lists):
        for j in own:
            reverse[j].append(i)
    out = []
    for i in range(n):
        both = np.unique(np.append(lists[i], reverse[i]).astype(np.int64))
        out.append(both if len(both) <= int(1.3 * degree) else both[robust_prune(ids[both], vec[both], vec[i], degree, alpha)])
    return out


def greedy_search(vec: np.ndarray, ids: np.ndarray, graph: list[np.ndarray], entry: int, query: np.ndarray, size: int, more: list[int] | None = None, keep: np.ndarray | None = None) -> tuple[list[tuple[float, int]], int, int]:
    """Best-first search with a list of `size`: ((distance, position) sorted, hops, distances computed).

    more: further entries. keep: which rows may be results; the walk goes through the others too, and has a
    list of its own for the kept ones.
    """
    start = sorted({entry, *(more or [])})
    seen, work = bytearray(len(ids)), len(start)
    for i in start:
        seen[i] = 1
    queue = sorted((float(((vec[i] - query) ** 2).sum()), int(ids[i]), i) for i in start)
    kept, done, hops, at = [x for x in queue if keep is None or keep[x[2]]], set(), 0, 0
    while True:
        while at < len(queue) and queue[at][2] in done:
            at += 1
        if at == len(queue):
            return [(x[0], x[2]) for x in (queue if keep is None else kept)[:size]], hops, work
        done.add(here := queue[at][2])
        hops += 1
        fresh = [j for j in graph[here].tolist() if not seen[j]]
        work += len(fresh)
        for d, j in zip(((vec[fresh] - query) ** 2).sum(1).tolist() if fresh else (), fresh, strict=True):
            seen[j] = 1
            x = (d, int(ids[j]), j)
            if len(queue) < size or x < queue[-1]:
                at = min(at, bisect.bisect(queue, x))
                bisect.insort(queue, x)
                del queue[size:]
            if keep is not None and keep[j]:
                bisect.insort(kept, x)
                del kept[size:]
