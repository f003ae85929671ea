"""Change logs as streams: micro-batches are applied by the same functions as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(tag, seq, op) of the last change of each tag; tombstones stay until they are consolidated."""
    both = current.select("tag", "seq", "op").unionByName(changes.where("tag is not null and tag <> 0").select("tag", "seq", "op"))
    return both.groupBy("tag").agg(F.max(F.struct("seq", "op")).alias("x")).select("tag", "x.seq", "x.op")


def start_upserts(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "2 seconds"):
    """Apply a stream of changes every interval, or all that is there and then end (None); write gets the new table and the batch number.

    A batch that is replayed after a failure gives the same table: the last change by seq wins.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: write(apply_changes(read(), batch), n)).option("checkpointLocation", checkpoint).trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def windowed_changes(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of changes by window and operation, late rows by watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n"))
