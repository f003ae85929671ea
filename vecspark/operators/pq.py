"""Product quantisation: codebooks fitted on a bounded sample, rotation, codes, and searches over them.

A codebook is an array (chunks, codes, width) over equal chunks of the vectors. It is a few hundred KB
whatever the table, so it is broadcast; codes and vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search as S

CODES = 256


def train_codebook(x: np.ndarray, chunks: int, codes: int = CODES, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """The centres of each chunk of the rows of x; the dimension must be a multiple of chunks."""
    from .index import kmeans

    if not 0 < chunks <= x.shape[1] or x.shape[1] % chunks:
        raise ValueError("the dimension must be a multiple of the chunks")
    width = x.shape[1] // chunks
    return np.stack([kmeans(x[:, i * width : (i + 1) * width], codes, rounds, seed + i) for i in range(chunks)])


def train_rotation(x: np.ndarray, chunks: int, codes: int = CODES, rounds: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, codebook): turns of quantising x @ rotation and of the rotation nearest to what that gives back."""
    r = np.eye(x.shape[1])
    for turn in range(rounds):
        book = train_codebook(x @ r, chunks, codes, 8, seed + turn)
        u, _, v = np.linalg.svd(x.T @ decode(book, encode(book, x @ r)))
        r = u @ v
    return r, train_codebook(x @ r, chunks, codes, 12, seed)


def encode(book: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest code of each chunk; ties go to the smaller one."""
    width = book.shape[2]
    return np.stack([S.pairwise("l2", x[:, i * width : (i + 1) * width], c).argmin(1) for i, c in enumerate(book)], axis=1) if len(x) else np.empty((0, len(book)), np.int64)


def decode(book: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([c[codes[:, i]] for i, c in enumerate(book)], axis=1)


def code_distance(book: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of what two rows of codes stand for, chunk by chunk."""
    return sum(((c[a[:, i]] - c[b[:, i]]) ** 2).sum(1) for i, c in enumerate(book))


def tables(book: np.ndarray, q: np.ndarray, metric: str = "l2") -> np.ndarray:
    """(query, chunk, code): squared distances, or negated products, of the queries' chunks and the centres."""
    width = book.shape[2]
    return np.stack([S.pairwise(metric, q[:, i * width : (i + 1) * width], c) for i, c in enumerate(book)], axis=1)


def quantized(table: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables as whole numbers of `bits` bits: (numbers, step of each query, least value of each query and chunk)."""
    low = table.min(2)
    step = np.maximum((table.max(2) - low).max(1) / ((1 << bits) - 1), 1e-300)
    return np.rint((table - low[:, :, None]) / step[:, None, None]).astype(np.int64), step, low


def lookup(book: np.ndarray, x: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of rows x, a function from a query to the distances of their codes."""
    codes = encode(book, x)
    return lambda q: tables(book, q[None])[0][np.arange(len(book)), codes].sum(1)


def encode_table(base: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, codes, vec) of rows (id, vec); null vectors are left out."""
    shared = base.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "codes": list(encode(shared.value, S._matrix(b["vec"])).astype(np.int16)), "vec": b["vec"]})

    return base.where("vec is not null").select("id", "vec").mapInPandas(run, "id long, codes array<short>, vec array<double>")


def adc_topk(queries: DataFrame, coded: DataFrame, book: np.ndarray, k: int, subset: int = 1, bits: int = 0) -> DataFrame:
    """(qid, rank, id, distance) of the k least code distances, by (distance, id); queries come in blocks.

    subset: every so-manieth chunk is scored, scaled up; bits: tables are rounded to whole numbers of so many bits.
    """

    def search(qids: np.ndarray, q: np.ndarray) -> DataFrame:
        shared = coded.sparkSession.sparkContext.broadcast((qids, tables(book, q) if len(qids) else None))

        def run(batches):
            qids, table = shared.value
            if bits and len(qids):
                whole, step, low = quantized(table, bits)
            for b in batches:
                if len(b) and len(qids):
                    codes, ids = np.vstack(b["codes"].to_list()).astype(np.int64), b["id"].to_numpy()
                    use = np.arange(0, table.shape[1], subset)
                    if bits:
                        d = whole[:, use[:, None], codes[:, use].T].sum(1) * step[:, None] + low[:, use].sum(1)[:, None]
                    else:
                        d = table[:, use[:, None], codes[:, use].T].sum(1)
                    d = np.round(d * (table.shape[1] / len(use)), 9)
                    r, c = S._best(d, ids, k)
                    yield pd.DataFrame({"qid": qids[r], "id": ids[c], "distance": d[r, c]})

        return coded.select("id", "codes").mapInPandas(run, "qid long, id long, distance double")

    return S.rank_per_query(S.by_query_blocks(queries, search, S.QUERY_BYTES // 32), k)


def refine(queries: DataFrame, found: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, distance): the k nearest by their vectors of the candidates found (qid, id)."""
    from vecspark.functions.vectors import l2

    near = found.select("qid", "id").join(base.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return S.rank_per_query(near.select("qid", "id", l2(F.col("vec"), F.col("qvec")).alias("distance")), k)


def reconstruction(coded: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, error): the squared distance of each vector to what its codes give back."""
    shared = coded.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            if len(b):
                x = S._matrix(b["vec"])
                yield pd.DataFrame({"id": b["id"], "error": ((x - decode(shared.value, np.vstack(b["codes"].to_list()).astype(np.int64))) ** 2).sum(1)})

    return coded.select("id", "codes", "vec").mapInPandas(run, "id long, error double")


