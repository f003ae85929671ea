"""Building, placing, caching and publishing cells.

Greedy choices run in one task a community or cell: what such a group holds is bounded by its own size, never by the
table's. The rest are joins and windows.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import relational as R
from .lineage import cut


def pack_cells(cells: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """(group, order, size, pack): cells next to each other in a group, packed while their sizes stay within capacity.

    A cell over the capacity has a pack of its own. A task holds the cells of a group, not their rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        pack, room, at = [], capacity, 0
        for i, n in enumerate(pdf[size]):
            if i and n > room:
                at, room = at + 1, capacity
            room -= n
            pack.append(at)
        return pdf.assign(pack=np.array(pack, np.int64))

    return cells.select(group, order, size).groupBy(group).applyInPandas(run, f"{group} long, {order} long, {size} long, pack long")


def lru_replay(touches: DataFrame, key: str, order: list[str], page: str, capacity: int) -> DataFrame:
    """(key, accesses, hits, misses, evictions): the touches of each key in order, through a page cache of its own.

    The cache holds `capacity` pages and lets the one used least recently go. A key's state is its cache alone:
    its touches come sorted, a batch at a time.
    """
    if capacity < 1:
        raise ValueError("a cache holds at least one page")
    rows = touches.select(key, *order, page).repartition(key).sortWithinPartitions(key, *order).select(key, page)

    def run(batches):
        at, cache, n = None, OrderedDict(), [0, 0, 0]
        for b in batches:
            out = []
            for k, p in zip(b[key], b[page], strict=True):
                if k != at:
                    if at is not None:
                        out.append((at, *n))
                    at, cache, n = k, OrderedDict(), [0, 0, 0]
                n[0] += 1
                if p in cache:
                    n[1] += 1
                    cache.move_to_end(p)
                else:
                    cache[p] = True
                    if len(cache) > capacity:
                        cache.popitem(last=False)
                        n[2] += 1
            if out:
                yield pd.DataFrame(out, columns=["k", "accesses", "hits", "evictions"])
        if at is not None:
            yield pd.DataFrame([(at, *n)], columns=["k", "accesses", "hits", "evictions"])

    got = rows.where(F.col(key).isNotNull()).mapInPandas(run, "k long, accesses long, hits long, evictions long")
    return got.select(F.col("k").alias(key), "accesses", "hits", (F.col("accesses") - F.col("hits")).alias("misses"), "evictions")


def assigned_cells(nodes: DataFrame, assignment: DataFrame, target: int) -> DataFrame:
    """(cell_id, order, id, community_id) of an assignment (node_id, community_id, cell_id, order).

    An error unless it has every node of nodes (id) once and no other, each cell has at most `target` nodes, is in
    one community, and numbers its nodes from 0.
    """
    each = assignment.groupBy("node_id").agg(F.count("*").alias("times"))
    matched = nodes.select("id").distinct().join(each, F.col("id") == F.col("node_id"), "full")
    wrong = matched.where("id is null or node_id is null or times <> 1").limit(1).count()
    size = F.count("*")
    cells = assignment.groupBy("cell_id").agg(size.alias("n"), F.countDistinct("community_id").alias("homes"), F.countDistinct("order").alias("places"), F.min("order").alias("first"), F.max("order").alias("last"))
    bad = cells.where((F.col("n") > target) | (F.col("homes") != 1) | (F.col("places") != F.col("n")) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1)).limit(1).count()
    if wrong or bad:
        raise ValueError("the assignment has not every node once" if wrong else "a cell of the assignment is too large, in two communities, or not numbered from 0")
    return assignment.select("cell_id", "order", F.col("node_id").alias("id"), "community_id")


def cell_pages(cells: DataFrame, per_page: int) -> DataFrame:
    """(id, cell_id, page, slot) of (cell_id, order, id): each cell starts a page, its nodes fill pages in their order."""
    sizes = cells.groupBy("cell_id").agg(F.ceil(F.count("*") / per_page).alias("pages"))
    first = R.running(sizes, "cell_id", "pages", "upto").select("cell_id", (F.col("upto") - F.col("pages")).alias("first"))
    return cells.join(first, "cell_id").select("id", "cell_id", (F.col("first") + F.floor(F.col("order") / per_page)).alias("page"), (F.col("order") % per_page).cast("long").alias("slot"))


def place_by_links(edges: DataFrame, members: DataFrame, per_page: int) -> DataFrame:
    """(cell, id, place): the nodes of each cell ordered so that linked ones share a page.

    The next node has the most links with the last `per_page` placed ones, where a link each way counts four;
    ties, and the first node, go by the smaller id. One cell is in a task.
    """
    m = members.select("id", "cell")
    ends = m.select(F.col("id").alias("src"), "cell").join(edges.select("src", "dst").distinct(), "src").join(m.select(F.col("id").alias("dst"), F.col("cell").alias("other")), "dst")
    rows = ends.where("cell = other and src <> dst").select("cell", "src", "dst").unionByName(m.select("cell", F.col("id").alias("src"), F.col("id").alias("dst")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate((pdf["src"], pdf["dst"])), return_inverse=True)
        a, b = at[: len(pdf)], at[len(pdf) :]
        own = a != b
        to = set(zip(a[own].tolist(), b[own].tolist(), strict=True))
        near: list[dict[int, int]] = [{} for _ in ids]
        for i, j in to:
            near[i][j] = near[j][i] = 4 if (j, i) in to else 1
        score, placed, free = np.zeros(len(ids), np.int64), [], np.ones(len(ids), bool)
        while len(placed) < len(ids):
            best = int(np.argmax(np.where(free, score, -1)))
            placed.append(best)
            free[best] = False
            for j, w in near[best].items():
                score[j] += w
            if len(placed) > per_page:
                for j, w in near[placed[-1 - per_page]].items():
                    score[j] -= w
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "id": ids[placed], "place": np.arange(len(ids))})

    return rows.groupBy("cell").applyInPandas(run, "cell long, id long, place long")


def coaccess_cells(together: DataFrame, visits: DataFrame, members: DataFrame, target: int) -> DataFrame:
    """(community, cell, order, id): cells of up to `target` nodes of a community that queries visit together.

    together: (node_a, node_b, together); visits: (node_id, visit_count); members: (id, community, source_cell).
    A cell starts at the free node with the most co-access, then visits, and takes the free node with the most
    co-access to it; then free nodes of its nodes' source cells fill it. Nodes that were never co-accessed stay by
    their source cells, in runs of `target`. In a cell nodes are ordered by visits. One community is in a task.
    """
    m = members.select("id", "community", "source_cell").join(visits.select(F.col("node_id").alias("id"), "visit_count"), "id", "left").withColumn("visit_count", F.coalesce("visit_count", F.lit(0)))
    home = m.select(F.col("id").alias("node_a"), "community")
    inner = together.join(home, "node_a").join(home.select(F.col("node_a").alias("node_b"), F.col("community").alias("other")), "node_b").where("community = other")
    none = F.lit(None).cast("long")
    rows = m.select("community", "id", none.alias("b"), F.col("source_cell").alias("w"), "visit_count").unionByName(inner.select("community", F.col("node_a").alias("id"), F.col("node_b").alias("b"), F.col("together").alias("w"), none.alias("visit_count")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, links = pdf[pdf["b"].isna()], pdf[pdf["b"].notna()]
        visits = {int(i): int(v) for i, v in zip(nodes["id"], nodes["visit_count"], strict=True)}
        source = {int(i): int(c) for i, c in zip(nodes["id"], nodes["w"], strict=True)}
        near: dict[int, dict[int, int]] = {}
        for a, b, w in zip(links["id"], links["b"].astype("int64"), links["w"], strict=True):
            near.setdefault(int(a), {})[int(b)] = int(w)
            near.setdefault(int(b), {})[int(a)] = int(w)
        by_source: dict[int, list[int]] = {}
        for i in sorted(source):
            by_source.setdefault(source[i], []).append(i)
        free, cells = set(visits), []
        for seed in sorted(near, key=lambda i: (-sum(near[i].values()), -visits[i], i)):
            if seed not in free:
                continue
            cell, pull, best = [], {}, seed
            while best is not None and len(cell) < target:
                cell.append(best)
                free.discard(best)
                pull.pop(best, None)
                for j, w in near[best].items():
                    if j in free:
                        pull[j] = pull.get(j, 0) + w
                best = min(pull, key=lambda i: (-pull[i], -visits[i], i), default=None)
            for i in (i for c in sorted({source[i] for i in cell}) for i in by_source[c] if i in free):
                if len(cell) == target:
                    break
                cell.append(i)
            free.difference_update(cell)
            cells.append(cell)
        for c in sorted(by_source):
            rest = sorted((i for i in by_source[c] if i in free), key=lambda i: (-visits[i], i))
            cells += [rest[i : i + target] for i in range(0, len(rest), target)]
        out = [(pdf["community"].iloc[0], n, k, i) for n, cell in enumerate(cells) for k, i in enumerate(sorted(cell, key=lambda i: (-visits[i], i)))]
        return pd.DataFrame(out, columns=["community", "cell", "order", "id"])

    return rows.groupBy("community").applyInPandas(run, "community long, cell long, order long, id long")


def principal_ranks(book: np.ndarray) -> np.ndarray:
    """ranks[chunk][code]: the place of a code's pivot along its chunk's main axis, whose largest part is positive."""
    out = np.empty(book.shape[:2], np.int64)
    for c, pivots in enumerate(np.asarray(book, np.float64)):
        spread = pivots - pivots.mean(0)
        axis = np.linalg.svd(spread, full_matrices=False)[2][0]
        axis = axis * (1 if axis[np.abs(axis).argmax()] >= 0 else -1)
        out[c, np.argsort(spread @ axis, kind="stable")] = np.arange(len(pivots))
    return out


def locality_keys(codes: np.ndarray, book: np.ndarray, dims: int) -> np.ndarray:
    """Of each row of codes a key of 63 bits at most that interleaves the ranks of `dims` chunks spread over all."""
    dims = max(1, min(dims, 32, book.shape[0]))
    bits = min(8, 63 // dims)
    picked = np.linspace(0, book.shape[0] - 1, dims).astype(int)
    level = principal_ranks(book)[picked] * (1 << bits) // book.shape[1]
    key = np.zeros(len(codes), np.int64)
    for d, c in enumerate(picked):
        own = level[d][codes[:, c]]
        for bit in range(bits):
            key |= ((own >> bit) & 1) << (bit * dims + d)
    return key


def locality_cells(coded: DataFrame, book: np.ndarray, size: int, dims: int = 8) -> DataFrame:
    """(id, cell_id, order): codes (id, codes) in order of (locality key, id), cut into cells of `size`."""
    shared = coded.sparkSession.sparkContext.broadcast(np.asarray(book))

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "key": locality_keys(np.vstack(b["codes"].to_list()).astype(np.int64), shared.value, dims)})

    keyed = coded.select("id", "codes").mapInPandas(run, "id long, key long").withColumn("at", F.struct("key", "id"))
    n = R.numbered(keyed, "at", "n")
    return n.select("id", F.floor(F.col("n") / size).alias("cell_id"), (F.col("n") % size).cast("long").alias("order"))


def sphere_points(spark: SparkSession, n: int, dim: int, radius: float, seed: int = 0) -> DataFrame:
    """(id, vec, is_frozen): n start points at random on a sphere, for an index without rows; the same for a seed."""
    unit = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), "id", i, F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2)))
    rows = spark.range(n).select("id", normal.alias("g"))
    length = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("id", F.transform("g", lambda x: x / length * radius).alias("vec"), F.lit(True).alias("is_frozen"))


def merged_mapping(mapping: DataFrame, merges: DataFrame) -> DataFrame:
    """(cell, target) after merges (a, b) of disjoint cells: what led to b leads to a."""
    moved = merges.select(F.col("b").alias("target"), F.col("a").alias("into"))
    return mapping.join(moved, "target", "left").select("cell", F.coalesce("into", "target").alias("target"))


def publish_mapping(mapping: DataFrame, path: str, expected: int) -> int:
    """Write a mapping as the generation after `expected`, and return its number.

    An error if another one was published since, or is being written: a generation's folder is made once.
    """
    if expected != current_generation(mapping.sparkSession, path):
        raise ValueError("another generation was published: read it and merge again")
    mapping.write.mode("errorifexists").parquet(f"{path}/generation={expected + 1}")
    return expected + 1


def current_generation(spark: SparkSession, path: str) -> int:
    """The newest generation that was written to its end; 0 where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = [0]
    for f in files.listStatus(folder) if files.exists(folder) else []:
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            done.append(int(f.getPath().getName().split("=")[1]))
    return max(done)


def route_profile(queries: DataFrame, training: DataFrame, hits: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, cell): the k cells that training queries of a query's bucket visited most.

    queries and training: (id, vec); hits: (query_id, cell), a row a visit; buckets: (center, cvec), bounded.
    """
    own = lambda q: R.nearest_centers(q, buckets).select(F.col("id").alias("query_id"), "center")
    n = hits.join(own(training), "query_id").groupBy("center", "cell").agg(F.count("*").alias("n"))
    ranked = cut(n.withColumn("rank", F.row_number().over(Window.partitionBy("center").orderBy(F.desc("n"), "cell")).cast("long")).where(F.col("rank") <= k))
    return own(queries).join(ranked, "center").select("query_id", "rank", "cell")
