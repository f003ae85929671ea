"""Binary vector files, ground truth, results, codebooks, CSV tables, and manifests that bind artifacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bin(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(id, vec) of files with a header of two u32 (rows, dimension) and row-major values.

    Files are read whole, one a task: shard a large set over many files. Ids number the rows of a file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                n, dim = np.frombuffer(data, "<u4", 2)
                x = np.frombuffer(data, np.dtype(dtype).newbyteorder("<"), int(n) * int(dim), 8).reshape(n, dim)
                for lo in range(0, n, 10_000):
                    yield pd.DataFrame({"id": np.arange(lo, min(n, lo + 10_000)), "vec": list(x[lo : lo + 10_000].astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, vec array<double>")


def read_vecs(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(id, vec) of files in which every row begins with its dimension (fvecs, ivecs, bvecs)."""
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                dim = int(np.frombuffer(data, "<i4", 1)[0])
                x = np.frombuffer(data, np.uint8).reshape(-1, 4 + dim * size)[:, 4:].copy().view(np.dtype(dtype).newbyteorder("<"))
                yield pd.DataFrame({"id": np.arange(len(x)), "vec": list(x.astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, vec array<double>")


def bin_bytes(rows: list[list[float]], dtype: str = "float32") -> bytes:
    x = np.array(rows, np.dtype(dtype).newbyteorder("<"))
    return np.array(x.shape, "<u4").tobytes() + x.tobytes()


#: Bytes that a file written from the driver may have: result sets, truth sets and codebooks, not vector tables.
FILE_BYTES = 256 << 20


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file anywhere Spark can write: beside it first, then renamed, so that no reader sees a part."""
    if len(data) > FILE_BYTES:
        raise ValueError(f"{len(data)} bytes are more than the {FILE_BYTES} of one file: write a table instead")
    where, files = _path(spark, path)
    beside = where.suffix(".part")
    out = files.create(beside, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"can't rename to {path}")


def read_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def _rows(df: DataFrame, column: str, item: int) -> pd.DataFrame:
    """The rows of a bounded table in order of id; the size is checked before they are collected."""
    n, dim = df.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    if n * (dim + 1) * item > FILE_BYTES:
        raise ValueError("too large for one file: split the ids over several")
    return df.orderBy("id").toPandas()


def save_bin(df: DataFrame, path: str, dtype: str = "float32") -> None:
    """Write (id, vec) in order of id as a file that read_bin reads; without rows a header of zeros."""
    rows = _rows(df.select("id", "vec"), "vec", np.dtype(dtype).itemsize)
    x = np.array(rows["vec"].to_list()).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    write_file(df.sparkSession, path, bin_bytes(x, dtype))


def save_vecs(df: DataFrame, path: str, dtype: str = "float32") -> None:
    """Write (id, vec) in order of id as a file that read_vecs reads: each row begins with its dimension."""
    rows = _rows(df.select("id", "vec"), "vec", np.dtype(dtype).itemsize)
    kind = np.dtype(dtype).newbyteorder("<")
    write_file(df.sparkSession, path, b"".join(np.array([len(v)], "<i4").tobytes() + np.asarray(v).astype(kind).tobytes() for v in rows["vec"]))


def save_truth(found: DataFrame, path: str, k: int, distances: bool = True) -> None:
    """Write (qid, rank, id, distance) as rows, k, ids and distances; queries in order, k results each or an error."""
    rows = found.where(F.col("rank") <= k).orderBy("qid", "rank").select("qid", "rank", "id", "distance").toPandas()
    n = rows["qid"].nunique()
    if len(rows) != n * k:
        raise ValueError("a query has fewer than k results")
    data = np.array([n, k], "<u4").tobytes() + rows["id"].to_numpy().astype("<u4").tobytes()
    write_file(found.sparkSession, path, data + (rows["distance"].to_numpy().astype("<f4").tobytes() if distances else b""))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, distance) of a truth file; the distance is null where its size says that there are none."""
    data = read_file(spark, path)
    n, k = (int(x) for x in np.frombuffer(data, "<u4", 2))
    if len(data) not in (8 + 4 * n * k, 8 + 8 * n * k):
        raise ValueError(f"{path} has {len(data)} bytes, which no truth set of {n} x {k} has")
    ids = np.frombuffer(data, "<u4", n * k, 8).tolist()
    far = np.frombuffer(data, "<f4", n * k, 8 + 4 * n * k).astype(float).tolist() if len(data) > 8 + 4 * n * k else [None] * (n * k)
    rows = [(i // k, i % k + 1, ids[i], far[i]) for i in range(n * k)]
    return spark.createDataFrame(rows, "qid long, rank long, id long, distance double")


def save_results(found: DataFrame, prefix: str, size: int) -> None:
    """Write the ids and the distances of (qid, rank, id, distance) as two files, named by the search-list size."""
    rows = found.orderBy("qid", "rank").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("r")).select(F.col("qid").alias("id"), "r")
    save_bin(rows.select("id", F.transform("r", lambda x: x["id"].cast("double")).alias("vec")), f"{prefix}_{size}_idx_uint32.bin", "uint32")
    save_bin(rows.select("id", F.transform("r", lambda x: x["distance"]).alias("vec")), f"{prefix}_{size}_dists_float.bin")


def save_codebook(spark: SparkSession, path: str, book: np.ndarray) -> None:
    """Write an array of centres behind its shape, with a checksum of both."""
    body = np.array([book.ndim, *book.shape], "<u4").tobytes() + book.astype("<f8").tobytes()
    write_file(spark, path, b"VSCB\x01\0\0\0" + np.array([fnv1a(body)], "<u8").tobytes() + body)


def load_codebook(spark: SparkSession, path: str) -> np.ndarray:
    """The centres of a file of save_codebook; an error if it is of another kind or damaged."""
    data = read_file(spark, path)
    if data[:8] != b"VSCB\x01\0\0\0" or len(data) < 20 or np.frombuffer(data, "<u8", 1, 8)[0] != fnv1a(data[16:]):
        raise ValueError(f"{path} is not a whole codebook")
    dims = int(np.frombuffer(data, "<u4", 1, 16)[0])
    shape = np.frombuffer(data, "<u4", dims, 20)
    return np.frombuffer(data, "<f8", offset=20 + 4 * dims).reshape(shape).copy()


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a checksum."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def checksums(df: DataFrame, column: str) -> DataFrame:
    """df and the FNV-1a (16 hexadecimal digits), CRC-32 and SHA-256 of a text column; null for null."""

    @F.pandas_udf("string")
    def fnv(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f"{fnv1a(x.encode()):016x}")

    data = F.col(column).cast("binary")
    return df.withColumn("fnv1a", fnv(F.col(column))).withColumn("crc32", F.crc32(data)).withColumn("sha256", F.sha2(data, 256))


def save_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Write a table as CSV files with a header, in ranges of the order; whole or not at all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table; an error if its header doesn't name the columns of the schema in their order."""
    want = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    have = spark.read.option("header", True).csv(path).columns
    if have != want:
        raise ValueError(f"{path} has columns {have}, not {want}")
    return spark.read.option("header", True).schema(schema).csv(path)


def load_tags(tags: DataFrame, base: DataFrame) -> DataFrame:
    """base with the tag of each row; an error unless every row has one, and no tag or row comes twice."""
    t = tags.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("tag").alias("tags")).first()
    n, both = base.count(), base.join(tags.select("id", "tag"), "id")
    if len({n, t.n, t.ids, t.tags, both.count()}) > 1:
        raise ValueError(f"{t.n} tags ({t.tags} different, for {t.ids} ids) don't fit {n} rows")
    return both


def folder_bytes(spark: SparkSession, prefix: str) -> int:
    """The bytes of all files whose path begins with a prefix."""
    where, files = _path(spark, prefix + "*")
    found = files.globStatus(where) or []
    return sum(files.getContentSummary(f.getPath()).getLength() for f in found)


def manifest(df: DataFrame, name: str) -> DataFrame:
    """(artifact, rows, fingerprint): an order-free checksum of a table, to bind artifacts to each other."""
    return df.agg(F.lit(name).alias("artifact"), F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def require_columns(df: DataFrame, **types: str) -> DataFrame:
    """df, or an error that names what is missing or of another type."""
    have = dict(df.dtypes)
    bad = {c: (have.get(c), t) for c, t in types.items() if have.get(c) != t}
    if bad:
        raise ValueError("columns differ: " + ", ".join(f"{c} is {h}, not {t}" for c, (h, t) in bad.items()))
    return df
