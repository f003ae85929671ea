"""Shared plumbing of the text operators: stage tables, document keys, byte-level word arrays.

Words are never held as Python strings on the hot path. An Arrow string column is one byte
buffer; word boundaries come from a 256-entry class table and word hashes from differences of
a running polynomial sum, so a pass over text costs a few numpy operations a byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker. One longer document is still whole.
CHUNK_BYTES = 1 << 19

#: Word classes fixed by the queries' contracts.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dir: list[str] = []
#: Lists that collect the paths of tables written while they are open (see recorded).
_recorders: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a temporary folder if master is
    local (tests), and an error on a cluster, whose executors would each write their own.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="vecspark-"))
    return _local_dir[0]


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that materialize writes in a block, for discard once they are read."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where, files = _path(spark, path)
        files.delete(where, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage on storage that survives the loss of executors, and lets Spark delete the
    shuffle files behind the write as soon as it ends. The table goes when the driver's JVM ends, or
    sooner by recorded and discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def confs(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set runtime configurations (dots written as __) for a block."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What this worker learnt for an operator's next task.
kept: dict[tuple, object] = {}


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable:
    """run, giving back the memory of its buffers when a task ends: workers stay while other stages run.

    An operator that keeps nothing itself also drops what another one kept in this worker.
    """

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            kept.clear()
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return outer


def doc_key() -> Column:
    """A key for a document row that also tells apart rows with null or repeated doc_id."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(_k, doc_id, text) of documents; other columns, whatever their names, are left out."""
    return docs.select(doc_key().alias("_k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_table(separators: bytes | None = None, *, alnum: bool = False) -> np.ndarray:
    """256 booleans: which bytes belong to words."""
    if alnum:
        inside = np.zeros(256, bool)
        inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
        return inside
    inside = np.ones(256, bool)
    inside[list(separators if separators is not None else SPACE_BYTES)] = False
    return inside


WORD_BYTES = class_table()
ALNUM_BYTES = class_table(alnum=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 2 * len(have[0]) if have else 0)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


class Words:
    """The words of a run of documents, as arrays over one byte buffer.

    data: the bytes; starts, ends: of each word; doc: its document's index; first[d]:first[d+1]
    are the words of document d.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = WORD_BYTES, lower: bool = False):
        self.bounds, self.n_docs = bounds, len(bounds) - 1
        self.data = LOWER[data] if lower else data
        n = len(self.data)
        self.member = member = inside[self.data]
        begin, stop = member.copy(), member.copy()
        begin[1:] &= ~member[:-1]
        stop[:-1] &= ~member[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]  # words that touch across documents
        begin[cuts] = member[cuts]
        stop[cuts - 1] = member[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: equal words, equal hashes, in every batch and task."""
        n = len(self.data)
        p, inverse = powers(_P, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * p[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each: the bytes, and each word's start and end there."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
        if len(ends):
            letters = np.ones(len(out), bool)
            letters[ends] = False
            out[letters] = self.data[self.member]
        return out, starts, ends


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes (across documents too; the caller masks these)."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    p, inverse = powers(_Q, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, bounds) of runs of rows; null texts are empty."""
    limit = limit or CHUNK_BYTES
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, where, data = col.buffers()
    bounds = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(col):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, stop, data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
        at = stop


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def bounded_sample(rows: DataFrame, limit_rows: int, limit_bytes: int, longest: int) -> list:
    """Rows of (h long, text string, ...), a sample for fitting a model: those with the smallest h.

    Rows with equal h are one row. Only texts of at most `longest` bytes take part. About limit_rows and at
    most twice limit_bytes and limit_rows come to the driver: rows and bytes are counted before they are
    collected, and the threshold on h falls until they fit. Whole texts are returned, in the order of h.
    """
    rows = rows.withColumn("_size", F.octet_length("text")).where(F.col("_size") <= longest)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if not n:
        return []
    share = min(1.0, limit_rows / n, limit_bytes / max(1, total))
    while True:
        pick = rows if share >= 1 else rows.where(F.col("h") < F.lit(int(-(1 << 63) + (1 << 64) * share)))
        n, total = pick.groupBy("h").agg(F.max("_size").alias("s")).agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0))).first()
        if n <= 2 * limit_rows and total <= 2 * limit_bytes:
            return sorted(pick.dropDuplicates(["h"]).drop("_size").collect(), key=lambda r: r.h)
        share = min(share, 1.0) / 2
