"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

Built-in DataFrame functions only. The count of documents per line is a pre-aggregated min and
max of doc_id, so a line that every document holds costs one row a task in the shuffle; the table
of repeated keys is written to the shared folder, so the join back to the lines has two plain
exchanges, which AQE may split where one key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keyed, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The normal form by which lines are equal: blanks stripped, ASCII letters lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _candidates(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_k, owner, pos, h1, h2) of every line long enough to count."""
    lines = docs.select("_k", F.coalesce("doc_id", F.lit(_LAST)).alias("owner"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("_k", "owner", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("_k", "owner", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(h1, h2, keeper) of keys in at least min_docs documents; keeper is the smallest doc_id."""
    found = _candidates(docs, min_chars)
    if min_docs == 2:
        return found.groupBy("h1", "h2").agg(F.min("owner").alias("keeper"), F.max("owner").alias("hi")).where("keeper < hi").drop("hi")
    held = found.select("h1", "h2", "owner").distinct()
    return held.groupBy("h1", "h2").agg(F.min("owner").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")


def line_dedup(documents: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Return (_k, doc_id, n_lines, n_dropped, kept): each document without its repeated lines.

    A key of at least min_chars code points found in min_docs documents stays only in the smallest
    doc_id that holds it (all of its lines there). Null text is one empty line. A null doc_id sorts
    last. Rows that share a doc_id are one document here. When every line goes, kept is empty.
    """
    docs = keyed(documents)
    keys = materialize(repeated_lines(docs, min_chars, min_docs), "lines")
    drops = _candidates(docs, min_chars).join(keys, ["h1", "h2"]).where("owner <> keeper").select("_k", "pos").distinct()
    drops = drops.groupBy("_k").agg(F.sort_array(F.collect_list("pos")).alias("drops"))
    out = docs.join(drops, "_k", "left").withColumn("lines", split_lines(F.col("text")))
    d, lines = F.col("drops"), F.col("lines")
    # What stays lies between consecutive dropped positions: slices, so the work is linear in the lines.
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(d, i - 1) + 1)
    stop = lambda i: F.when(i == F.size(d), F.size(lines)).otherwise(F.get(d, i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))
    return out.select(
        "_k",
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(d.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
