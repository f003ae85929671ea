"""A layered proximity index (small-world layers): each shard has a graph of all its rows and sparser ones above.

A row's top layer comes from a hash of its id, each layer having about 1/FAN of the rows of the one below. A search
climbs down greedily and walks the lowest layer with a list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as S

FAN, CAPACITY = 16, 4096


def layer_of(key) -> F.Column:
    """The top layer of a row: at least n with a chance of FAN ** -n."""
    unit = (F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 40)) + 1) / float(1 << 40)
    return F.floor(-F.log(unit) / float(np.log(FAN))).cast("long")


def build_layers(base: DataFrame, path: str, capacity: int = CAPACITY, degree: int = 16) -> DataFrame:
    """Write (shard, id, vec, layer, links) of base (id, vec) to a folder and read it back.

    Rows are dealt to shards of about `capacity` by hash; links[n] are a row's neighbours in layer n. Null vectors are
    left out, a repeated id is one row, and the table of an empty base is empty.
    """
    rows = base.where("vec is not null").select("id", "vec").dropDuplicates(["id"])
    shards = max(1, -(-rows.count() // capacity))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(shards)).alias("shard"), "id", "vec", layer_of("id").alias("layer"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, vec, top = pdf["id"].to_numpy(), S._matrix(pdf["vec"]), pdf["layer"].to_numpy()
        links: list[list[list[int]]] = [[] for _ in ids]
        for layer in range(int(top.max()) + 1):
            own = np.flatnonzero(top >= layer)
            for i, near in zip(own, S.build_graph(ids[own], vec[own], degree), strict=True):
                links[i].append(ids[own[near.astype(np.int64)]].tolist())
        return pdf.assign(links=links)

    dealt.groupBy("shard").applyInPandas(run, "shard long, id long, vec array<double>, layer long, links array<array<long>>").write.mode("overwrite").parquet(path)
    return open_layers(base.sparkSession, path)


def open_layers(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    missing = {"shard", "id", "vec", "layer", "links"} - set(found.columns)
    if missing:
        raise ValueError(f"{path} is no layered index: it has no {sorted(missing)}")
    return found


def layered_topk(queries: DataFrame, index: DataFrame, k: int, size: int = 64) -> DataFrame:
    """(qid, rank, id, distance): queries (qid, qvec) through every shard, and the k nearest of what they find.

    size: the list of the walk in the lowest layer, at least k. Queries come in blocks, as in exact_topk; a shard is in
    one task.
    """
    size = max(size, k)

    def search(qids: np.ndarray, q: np.ndarray) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast((qids, q))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            qids, q = shared.value
            pdf = pdf.sort_values("id", ignore_index=True)
            ids, vec = pdf["id"].to_numpy(), S._matrix(pdf["vec"])
            top = pdf["layer"].to_numpy()
            graphs = [[np.searchsorted(ids, np.asarray(x[n], np.int64)) if len(x) > n else np.empty(0, np.int64) for x in pdf["links"]] for n in range(int(top.max()) + 1)]
            first, out = int(np.argmax(top)), []
            for qid, query in zip(qids, q, strict=True):
                at = first
                for graph in graphs[:0:-1]:
                    at = S.greedy_search(vec, ids, graph, at, query, 1)[0][0][1]
                found = S.greedy_search(vec, ids, graphs[0], at, query, size)[0][:k]
                out += [(int(qid), int(ids[i]), d) for d, i in found]
            return pd.DataFrame(out, columns=["qid", "id", "distance"])

        return index.groupBy("shard").applyInPandas(run, "qid long, id long, distance double")

    return S.rank_per_query(S.by_query_blocks(queries, search), k)
