"""Iterative and greedy partitioners. Rounds are DataFrame aggregations against bounded centres;
greedy choices run on bounded groups, one task each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .search import pairwise

#: Rows that fit one greedy group; larger ones are first split by recursive_cells.
GROUP_ROWS = 50_000


def _centers(base: DataFrame, k: int, rounds: int = 6) -> np.ndarray:
    """k centres by Lloyd rounds over all rows; a task sends k sums, not its rows."""
    first = base.where("vec is not null").select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(k).collect()
    c = np.array([r.vec for r in sorted(first, key=lambda r: r.id)], np.float64)
    for _ in range(rounds):
        shared = base.sparkSession.sparkContext.broadcast(c)

        def sums(batches, shared=shared):
            total, n = np.zeros_like(shared.value), np.zeros(len(shared.value))
            for b in batches:
                if len(b):
                    x = np.vstack(b["vec"].to_list()).astype(np.float64)
                    own = np.argmin(pairwise("l2", x, shared.value), axis=1)
                    np.add.at(total, own, x)
                    n += np.bincount(own, minlength=len(n))
            yield pd.DataFrame({"center": np.arange(len(n)), "n": n, "s": list(total)})

        rows = base.where("vec is not null").select("vec").mapInPandas(sums, "center long, n double, s array<double>").groupBy("center").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(c.shape[1]))).collect()
        for r in rows:
            if r.n:
                c[r.center] = np.array(r[2:]) / r.n
    return c


def balanced_partition(base: DataFrame, k: int, imbalance: float = 0.05) -> DataFrame:
    """(id, part): k parts of nearly equal size that follow k centres.

    Rows wish for their nearest centre; each part takes rows up to its capacity by (distance, id), what is
    left tries its next centre, and the last round fills the remaining room by rank. No part exceeds
    (1 + imbalance) times the mean, rounded up.
    """
    n = base.count()
    if not n:
        return base.select("id", F.lit(0).cast("long").alias("part"))
    c = _centers(base, min(k, n))
    cap = int(np.ceil(np.ceil(n / k) * (1 + imbalance)))
    shared = base.sparkSession.sparkContext.broadcast(c)

    def wishes(batches):
        for b in batches:
            if len(b):
                d = pairwise("l2", np.vstack(b["vec"].to_list()).astype(np.float64), shared.value)
                order = np.argsort(d, axis=1, kind="stable")
                yield pd.DataFrame({"id": b["id"], "parts": list(order), "dists": list(np.take_along_axis(d, order, 1))})

    left = base.where("vec is not null").select("id", "vec").mapInPandas(wishes, "id long, parts array<long>, dists array<double>")
    left = cut(left)
    placed = None
    for turn in range(len(c)):
        used = {} if placed is None else {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
        room = F.create_map(*[x for p in range(len(c)) for x in (F.lit(p).cast("long"), F.lit(cap - used.get(p, 0)))])
        wish = left.withColumn("part", F.get("parts", F.lit(turn))).withColumn("d", F.get("dists", F.lit(turn)))
        wish = wish.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("d", "id")))
        taken = cut(wish.where(F.col("r") <= room[F.col("part")]).select("id", "part"))
        placed = taken if placed is None else placed.unionByName(taken)
        left = cut(left.join(taken.select("id"), "id", "left_anti"))
        if not left.limit(1).count():
            break
    return placed


def recursive_cells(base: DataFrame, target: int, fan: int = 16) -> DataFrame:
    """(id, cell): groups of at most `target` rows by splitting into up to `fan` centres, level by level.

    A level deals rows out by (cell, centre); cells under the target are done, cells of at most GROUP_ROWS
    rows are split to the end in one task.
    """
    def split(x: np.ndarray, ids: np.ndarray, path: str, out: list) -> None:
        if len(ids) <= target:
            out += [(int(i), path) for i in ids]
            return
        k = min(fan, -(-len(ids) // target))
        c = x[np.linspace(0, len(ids) - 1, k).astype(int)].copy()
        for _ in range(8):
            own = np.argmin(pairwise("l2", x, c), axis=1)
            for j in range(k):
                if (own == j).any():
                    c[j] = x[own == j].mean(0)
                else:  # an empty centre takes the farthest row
                    c[j] = x[int(np.argmax(((x - c[own]) ** 2).sum(1)))]
        own = np.argmin(pairwise("l2", x, c), axis=1)
        if (own == own[0]).all():  # equal vectors: by order
            own = np.arange(len(ids)) * k // len(ids)
        for j in range(k):
            if (own == j).any():
                split(x[own == j], ids[own == j], f"{path}.{j}", out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        out: list = []
        split(np.vstack(pdf["vec"].to_list()).astype(np.float64), pdf["id"].to_numpy(), str(pdf["top"].iloc[0]), out)
        return pd.DataFrame(out, columns=["id", "cell"])

    rows = base.where("vec is not null").select("id", "vec")
    tops = -(-rows.count() // GROUP_ROWS)
    if tops > 1:
        rows = rows.join(balanced_partition(base, tops).withColumnRenamed("part", "top"), "id")
    else:
        rows = rows.withColumn("top", F.lit(0).cast("long"))
    return rows.groupBy("top").applyInPandas(run, "id long, cell string")


def label_communities(pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) of undirected (a, b, weight): nodes take the heaviest community around them.

    Synchronous rounds of aggregation, every other node in turn so that two don't swap for ever; ties go to
    the smaller community. Communities are renumbered by their least node.
    """
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight")))
    label = cut(both.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id")))
    for turn in range(rounds):
        near = both.join(label.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("weight").alias("w"))
        best = near.groupBy("u").agg(F.min(F.struct((-F.col("w")).alias("m"), "c"))["c"].alias("best"))
        moves = (F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2) & F.col("best").isNotNull()
        label = cut(label.join(best.select(F.col("u").alias("id"), "best"), "id", "left").select("id", F.when(moves, F.col("best")).otherwise(F.col("c")).alias("c")))
    least = label.groupBy("c").agg(F.min("id").alias("community"))
    return label.join(least, "c").select("id", "community")


def louvain_groups(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The community of nodes 0 to n - 1 by Louvain, over undirected pairs (u = v: a loop).

    Nodes move one after the other to the neighbouring community with the largest modularity gain (ties: the
    smaller) until none gains; communities then become the nodes of a coarser graph, until none of these moves.
    """
    group = np.arange(n)
    while True:
        degree = np.bincount(u, w, n) + np.bincount(v, w, n)
        m2 = degree.sum()
        real = u != v
        ends, other, weight = np.concatenate((u[real], v[real])), np.concatenate((v[real], u[real])), np.concatenate((w[real], w[real]))
        order = np.argsort(ends, kind="stable")
        first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
        other, weight = other[order].tolist(), weight[order].tolist()
        own, total, moved = list(range(n)), degree.tolist(), True
        k = degree.tolist()
        any_move = False
        while moved:
            moved = False
            for i in range(n):
                near: dict[int, float] = {}
                for j in range(first[i], first[i + 1]):
                    c = own[other[j]]
                    near[c] = near.get(c, 0.0) + weight[j]
                d = own[i]
                stay = near.get(d, 0.0) - k[i] * (total[d] - k[i]) / m2
                best, most = d, 1e-9 * max(1.0, k[i])
                for c in sorted(near):
                    gain = near[c] - k[i] * total[c] / m2 - stay if c != d else 0.0
                    if gain > most:
                        best, most = c, gain
                if best != d:
                    total[d] -= k[i]
                    total[best] += k[i]
                    own[i] = best
                    moved = any_move = True
        if not any_move:
            return group
        _, own = np.unique(own, return_inverse=True)
        group = own[group]
        n = int(own.max()) + 1
        lo, hi = np.minimum(own[u], own[v]), np.maximum(own[u], own[v])
        pair, at = np.unique(lo * n + hi, return_inverse=True)
        u, v, w = pair // n, pair % n, np.bincount(at, w)


def louvain_communities(pairs: DataFrame) -> DataFrame:
    """(id, community) of undirected (a, b, weight) by Louvain; a community is named by its least node.

    Nodes move in order, each by what the ones before it did: one task holds all pairs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        ids, at = np.unique(np.concatenate((pdf["a"], pdf["b"])), return_inverse=True)
        own = louvain_groups(at[: len(pdf)], at[len(pdf) :], pdf["weight"].to_numpy(np.float64), len(ids))
        return pd.DataFrame({"id": ids, "community": pd.Series(ids).groupby(own).transform("min")})

    return pairs.select("a", "b", "weight").groupBy(F.lit("all")).applyInPandas(run, "id long, community long")


def spherical_kmeans(base: DataFrame, key: str, k: int, rounds: int = 8) -> DataFrame:
    """(key, bin, n, cosine): k unit directions in each bounded group, by mean cosine; empty ones stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.vstack(pdf["vec"].to_list()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, best = x[:1], x @ x[0]
        while len(c) < min(k, len(x)):
            c = np.vstack((c, x[int(np.argmax(1 - best))]))
            best = np.maximum(best, x @ c[-1])
        own = np.full(len(x), -1)
        for _ in range(rounds):
            new = np.argmax(x @ c.T, axis=1)
            if (new == own).all():
                break
            own = new
            for j in range(len(c)):
                s = x[own == j].sum(0)
                if np.linalg.norm(s) > 0:
                    c[j] = s / np.linalg.norm(s)
        dots = (x * c[own]).sum(1)
        return pd.DataFrame([(pdf[key].iloc[0], j, int((own == j).sum()), float(dots[own == j].mean()) if (own == j).any() else 0.0) for j in range(len(c))], columns=[key, "bin", "n", "cosine"])

    return base.where("vec is not null").select(key, "id", "vec").groupBy(key).applyInPandas(run, f"{key} long, bin long, n long, cosine double")


def graph_local_cells(edges: DataFrame, members: DataFrame, target: int) -> DataFrame:
    """(community, cell, id): cells of up to `target` nodes, grown by links into the cell, degree and id."""
    m = members.select("id", "community")
    inner = edges.select("src", "dst").join(m.select(F.col("id").alias("src"), "community"), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("other")), "dst").where("community = other").select("community", "src", "dst")
    rows = inner.unionByName(m.select("community", F.col("id").alias("src"), F.col("id").alias("dst")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(a, set())
            near.setdefault(b, set())
            if a != b:
                near[a].add(b)
                near[b].add(a)
        free, out, cell = set(near), [], 0
        for seed in sorted(near, key=lambda i: (-len(near[i]), i)):
            if seed not in free:
                continue
            links, size, at = {seed: 0}, 0, seed
            while at is not None and size < target:
                free.discard(at)
                links.pop(at, None)
                out.append((pdf["community"].iloc[0], cell, at))
                size += 1
                for b in near[at]:
                    if b in free:
                        links[b] = links.get(b, 0) + 1
                at = min(links, key=lambda i: (-links[i], -len(near[i]), i), default=None)
            cell += 1
        return pd.DataFrame(out, columns=["community", "cell", "id"])

    return rows.groupBy("community").applyInPandas(run, "community long, cell long, id long")
