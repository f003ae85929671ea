"""Repeated passages: what both substring deduplicators share.

Every window of W words selects its least K-word gram by hash (the leftmost of equal ones). Equal
windows select equal grams at equal offsets, so copies can only meet under one gram. A selected gram
has a segment: all words of the windows that select it, about W + (W - K) / 2 of them. Only grams that
occur twice go on; of these, equal segments are one row with a count. Every such row goes to the
operator's matcher, in shards of whole grams.

A gram with very many different segments would make a shard of unbounded size: its segments are split
by the words around the gram, more of them each time, until each has few; at last a key is a whole
window, and has one. Either way every window is judged by the matcher.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import _Q, Words, gram_hashes, keyed, materialize, mix, powers, released, text_chunks

GRAM = 8
#: Different segments of a gram that one shard may hold, and words of a shard.
HEAVY, SHARD_WORDS = 1024, 40_000

#: A segment: its gram, its own hash, how often it occurs, its windows, the gram's place, its words.
Segment = tuple[int, int, int, int, int, np.ndarray]
#: From the segments of some grams, for each the bits of the windows that occur at least twice.
Matcher = Callable[[list[Segment], int], list[int]]


def select_grams(words: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, windows, place of the gram after it, segment hash) of a byte buffer's words.

    Windows are numbered by their first word.
    """
    grams = gram_hashes(h, gram)
    n, width = len(words) - window + 1, window - gram + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    low = np.uint64((1 << 28) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, least = 1, key
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - span :][: len(key) - width + 1])
    place = (least[:n] & low).astype(np.int64)
    start = np.flatnonzero(np.arange(n) + window <= words.first[1:][words.doc[:n]])  # within one document
    if not len(start):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    place = place[start]
    new = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
    head = np.flatnonzero(new)
    first, at = start[head], place[head]
    count = np.diff(np.append(head, len(start)))
    p, inverse = powers(_Q, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    own = mix((total[first + count + window - 1] - total[first]) * inverse[first] + (count << 8 | at - first).astype(np.uint64))
    return grams[at], first, count, at - first, own


def _rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, s, _k, at) of every segment; at packs its first word, windows and gram's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, bounds in text_chunks(batch):
                words = Words(data, bounds)
                g, first, count, place, own = select_grams(words, words.hashes(), window, gram)
                doc = words.doc[first]
                at = (first - words.first[doc]) << 16 | count << 8 | place
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(own.view(np.int64)), pa.array(keys[lo + doc]), pa.array(at)], ["g", "s", "_k", "at"])

    return docs.select("_k", "text").mapInArrow(released(run), "g long, s long, _k long, at long")


def _contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(g, s, n, at, words) for the segments `wanted` (g, s, n, _k, at): their word hashes."""
    lists = wanted.groupBy("_k").agg(F.collect_list(F.struct("g", "s", "n", "at")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch):
                words = Words(data, bounds)
                h = words.hashes().view(np.int64)
                lists = batch.column(1).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.array(lists.value_lengths().fill_null(0)))
                flat = lists.flatten()
                at = flat.field("at").to_numpy()
                first, size = words.first[doc] + (at >> 16), (at >> 8 & 255) + window - 1
                take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                content = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(h[take]))
                yield pa.RecordBatch.from_arrays([flat.field("g"), flat.field("s"), flat.field("n"), flat.field("at"), content], ["g", "s", "n", "at", "words"])

    once = docs.select("_k", "text").dropDuplicates(["_k"])  # rows that repeat a document give its segments once
    joined = once.join(lists, "_k").select("text", "wanted")
    return joined.mapInArrow(released(run), "g long, s long, n long, at long, words array<long>")


def _matched(contents: DataFrame, matcher: Matcher, window: int) -> DataFrame:
    """(g, s, mask): the matcher run on shards of whole grams."""

    def shard(segments: list[Segment]) -> pa.RecordBatch:
        masks = matcher(segments, window)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in segments], pa.int64()), pa.array([x[1] for x in segments], pa.int64()), pa.array(masks, pa.int64())], ["g", "s", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: list[Segment] = []
        size, last, seen = 0, None, set()
        for batch in batches:
            g, s, n, at = (batch.column(i).to_pylist() for i in range(4))
            lists = batch.column(4)
            flat, bounds = lists.flatten().to_numpy(), np.append(0, np.cumsum(np.array(lists.value_lengths())))
            for i in range(len(g)):
                if g[i] != last:
                    if size >= SHARD_WORDS:
                        yield shard(segments)
                        segments, size = [], 0
                    last, seen = g[i], set()
                if s[i] in seen:
                    continue
                seen.add(s[i])
                segments.append((g[i], s[i], n[i], at[i] >> 8 & 255, at[i] & 255, flat[bounds[i] : bounds[i + 1]]))
                size += int(bounds[i + 1] - bounds[i])
        if segments:
            yield shard(segments)

    return contents.repartition("g").sortWithinPartitions("g").mapInArrow(released(run), "g long, s long, mask long")


def _narrowed(contents: DataFrame, window: int, gram: int, reach: int) -> DataFrame:
    """Segments (g, s, off, n, at, words) split by the words up to `reach` before and after their gram: the same
    columns and the new keys (g2, s2), with off counting windows from the first one of the segment (g, s).

    Windows whose words before and after the gram go beyond the reach stay together; another window is
    alone, as it sees fewer words on one side. Equal windows get equal keys and places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, s, off, n, at = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            flat, bounds = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(np.array(lists.value_lengths())))
            out = [[] for _ in range(8)]
            for r in range(len(g)):
                words, count, place = flat[bounds[r] : bounds[r + 1]], at[r] >> 8 & 255, at[r] & 255
                i = 0
                while i < count:
                    before, after = min(place - i, reach), min(window - gram - place + i, reach)
                    stop = i + 1
                    if before == after == reach:
                        while stop < count and place - stop >= reach:
                            stop += 1
                    context = words[place - before : place + gram + after]
                    own = words[i : stop + window - 1]
                    key = int(mix(gram_hashes(context, len(context)) + np.uint64(before << 8 | after))[0])
                    same = int(mix(gram_hashes(own, len(own)) + np.uint64(stop - i << 8 | place - i))[0])
                    for column, value in zip(out, (g[r], s[r], off[r] + i, n[r], stop - i << 8 | place - i, own.view(np.int64), np.uint64(key).view(np.int64), np.uint64(same).view(np.int64)), strict=True):
                        column.append(value)
                    i = stop
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["g", "s", "off", "n", "at", "words", "g2", "s2"])

    return contents.select("g", "s", "off", "n", "at", "words").mapInArrow(released(run), "g long, s long, off long, n long, at long, words array<long>, g2 long, s2 long")


def _heavy(contents: DataFrame, matcher: Matcher, window: int, gram: int) -> list[DataFrame]:
    """(g, s, mask) of segments of grams with too many kinds for a shard: matched by longer and longer contexts."""
    left, reach, found = contents.dropDuplicates(["g", "s"]).withColumn("off", F.lit(0).cast("long")), 2, []
    while True:
        reach = min(2 * reach, window - gram)
        parts = materialize(_narrowed(left, window, gram, reach), "narrowed")
        kinds = parts.groupBy("g2", "s2").agg(F.count("*").alias("c")).groupBy("g2").agg(F.count("*").alias("kinds"))
        many = materialize(kinds.where(F.col("kinds") > HEAVY).select("g2"), "many")
        few = parts.join(many, "g2", "left_anti")
        one = few.groupBy("g2", "s2").agg(F.sum("n").alias("n"), F.first("at").alias("at"), F.first("words").alias("words"))
        masks = _matched(one.select(F.col("g2").alias("g"), F.col("s2").alias("s"), "n", "at", "words"), matcher, window).where("mask <> 0")
        masks = few.select("g", "s", "off", "g2", "s2").join(masks.select(F.col("g").alias("g2"), F.col("s").alias("s2"), "mask"), ["g2", "s2"])
        found.append(materialize(masks.select("g", "s", F.expr("shiftleft(mask, cast(off as int))").alias("mask")), "heavy"))
        if not many.limit(1).count():
            return found
        left = parts.join(many, "g2", "left_semi").drop("g2", "s2")


def repeated_windows(docs: DataFrame, window: int, gram: int, matcher: Matcher) -> DataFrame:
    """(_k, runs) of keyed documents: packed (at, mask) pairs, the windows that also start elsewhere."""
    if not 0 < window - gram + 1 < 63:
        raise ValueError("a window holds 1 to 62 grams")
    grams = materialize(_rows(docs, window, gram).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")
    found = materialize(_rows(docs, window, gram).join(grams, "g", "left_semi"), "segments")
    unique = materialize(found.groupBy("g", "s").agg(F.count("*").alias("n"), F.min(F.struct("_k", "at")).alias("one")).select("g", "s", "n", "one.*"), "unique")
    many = materialize(unique.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HEAVY).select("g"), "many")
    masks = _matched(_contents(docs, unique.join(many, "g", "left_anti"), window), matcher, window)
    if many.limit(1).count():
        for more in _heavy(_contents(docs, unique.join(many, "g", "left_semi"), window), matcher, window, gram):
            masks = masks.unionByName(more)
    masks = materialize(masks.where("mask <> 0").groupBy("g", "s").agg(F.bit_or("mask").alias("mask")), "masks")
    runs = found.join(masks, ["g", "s"]).groupBy("_k").agg(F.collect_set(F.struct("at", "mask")).alias("runs"))
    return materialize(runs, "runs")


def remove_repeats(documents: DataFrame, window: int, gram: int, matcher: Matcher) -> DataFrame:
    """(_k, doc_id, n_words, n_removed, kept, spans): documents without the words of repeated windows.

    kept joins the words that stay by one space; spans are (first, last) numbers of removed words, each
    as long as possible. All occurrences go, in the same document too, and rows that repeat a document
    repeat its windows. Null text has no words.
    """
    docs = keyed(documents)
    runs = repeated_windows(docs, window, gram, matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch):
                words = Words(data, bounds)
                lists = batch.column(3).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.array(lists.value_lengths().fill_null(0), np.int64))
                flat = lists.flatten()
                at, mask = flat.field("at").to_numpy(), flat.field("mask").to_numpy()
                edge = np.zeros(len(words) + window + 64, np.int64)
                for i in range(int((at >> 8 & 255).max()) if len(at) else 0):
                    start = (words.first[doc] + (at >> 16) + i)[(mask >> i & 1).astype(bool)]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + window, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                text, starts, ends = words.joined()
                stay = np.repeat(~gone, ends - starts + 1)
                kept, size = text[stay].tobytes(), np.bincount(words.doc[~gone], weights=(ends - starts + 1)[~gone], minlength=hi - lo).astype(np.int64)
                cut = np.append(0, np.cumsum(size))
                texts = pa.array([kept[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
                change = words.doc[1:] != words.doc[:-1]
                begins, stops = gone.copy(), gone.copy()
                begins[1:] &= ~gone[:-1] | change
                stops[:-1] &= ~gone[1:] | change
                first, last = np.flatnonzero(begins), np.flatnonzero(stops)
                own = words.doc[first]
                spans = pa.StructArray.from_arrays([pa.array(first - words.first[own]), pa.array(last - words.first[own])], ["first", "last"])
                spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=hi - lo))), pa.int32()), spans)
                removed = np.bincount(words.doc[gone], minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(removed), texts, spans], ["_k", "doc_id", "n_words", "n_removed", "kept", "spans"])

    return docs.join(runs, "_k", "left").mapInArrow(released(run), "_k long, doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>")
