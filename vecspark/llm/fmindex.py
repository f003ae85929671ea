"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of whole documents inside a task. Its words become symbols (benchmark words have
their own, a run of other words or a document's end is one separator), the suffix array is made by
prefix doubling over the still unordered suffixes, and the BWT goes into a wavelet matrix. All
benchmark windows are searched backwards at once; occurrences are located by walking to sampled
suffix positions. Documents are read once and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import _Q, ALNUM_BYTES, Words, keyed, materialize, mix, powers, released, text_chunks

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Benchmark words searched for at once (about 30 bytes each where they are broadcast; more are searched block by
#: block), and windows of one piece of an item: a longer item is cut, so no row and no block outgrows its bound.
BLOCK_WORDS, PIECE = 1 << 20, 4096
SAMPLE = 8


class Phrases:
    """The distinct windows of pieces of benchmark items, and the items of each.

    A window is a place and a length in the symbols of all pieces, so overlapping windows share their words.
    """

    def __init__(self, items: list[str | None], h: np.ndarray, bounds: np.ndarray, window: int):
        self.vocabulary, symbols = np.unique(h, return_inverse=True)
        self.symbols, self.window = (symbols + 2).astype(np.int32), window
        sizes = np.diff(bounds)
        counts = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
        at = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        length = np.repeat(np.minimum(sizes, window), counts)
        one, which = self._distinct(h, at, length)
        self.at, self.length = at[one].astype(np.int32), length[one].astype(np.int64)
        self.ids = sorted({i for i in items if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        item = np.array([number.get(i, -1) for i in items], np.int64).repeat(counts)
        pairs = np.unique(which[item >= 0] * max(1, len(self.ids)) + item[item >= 0])
        self.item_at = np.append(0, np.cumsum(np.bincount(pairs // max(1, len(self.ids)), minlength=len(one)))).astype(np.int64)
        self.items = pairs % max(1, len(self.ids))

    def _distinct(self, h: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct window, and each place's window."""
        p, inverse = powers(_Q, len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * p[: len(h)], out=total[1:])
        key = mix((total[at + length] - total[at]) * inverse[at] + length.astype(np.uint64))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        for i in range(self.window):  # by hash, then word by word
            rows = np.flatnonzero(length > i)
            if (self.symbols[at[rows] + i] != self.symbols[at[one[which[rows]]] + i]).any():
                words = np.zeros((len(at), self.window), np.int32)
                for j in range(self.window):
                    more = length > j
                    words[more, j] = self.symbols[at[more] + j]
                _, one, which = np.unique(words, axis=0, return_index=True, return_inverse=True)
                break
        return one, which.ravel()

    def back(self, which: np.ndarray, step: int) -> np.ndarray:
        """The symbol `step` places before the last one of windows."""
        return self.symbols[self.at[which] + self.length[which] - 1 - step].astype(np.int64)


class WaveletMatrix:
    def __init__(self, text: np.ndarray, n_symbols: int):
        self.levels = []
        for level in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (text >> level & 1).astype(bool)
            before = np.zeros(len(text) + 1, np.int32)
            np.cumsum(~ones, out=before[1:])
            self.levels.append((level, before, int(before[-1])))
            text = np.concatenate((text[~ones], text[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each position."""
        lo = np.zeros_like(at)
        for level, zeros, n_zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            lo = np.where(one, n_zeros + lo - zeros[lo], zeros[lo])
            at = np.where(one, n_zeros + at - zeros[at], zeros[at])
        return at - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for level, zeros, n_zeros in self.levels:
            one = zeros[at + 1] == zeros[at]
            symbol |= one.astype(np.int64) << level
            lo = np.where(one, n_zeros + lo - zeros[lo], zeros[lo])
            at = np.where(one, n_zeros + at - zeros[at], zeros[at])
        return symbol, at - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; a later round sorts only suffixes that still tie."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a tied suffix ranks as its group's first row
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    slots = np.flatnonzero(~new | ~np.append(new[1:], True))  # rows of groups of two or more
    step = 1
    while len(slots):
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        head = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[at] = head
        slots = slots[~new | ~np.append(new[1:], True)]
        step *= 2
    return order


class FMIndex:
    """Of symbols 0 .. n_symbols - 1; symbol 0 ends the text."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_array(text)
        self.tree = WaveletMatrix(text[order - 1], n_symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.marked = order % SAMPLE == 0
        self.sample = order[self.marked]
        self.nth = np.cumsum(self.marked) - 1

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, past the last row) of the phrases that occur."""
        which = np.arange(len(phrases.length))
        last = phrases.back(which, 0)
        lo, hi = self.before[last], self.before[last + 1]
        done = []
        for step in range(1, phrases.window + 1):
            live = hi > lo
            which, lo, hi = which[live], lo[live], hi[live]
            ended = phrases.length[which] == step
            done.append((which[ended], lo[ended], hi[ended]))
            which, lo, hi = which[~ended], lo[~ended], hi[~ended]
            if not len(which):
                break
            symbol = phrases.back(which, step)
            lo, hi = self.before[symbol] + self.tree.rank(symbol, lo), self.before[symbol] + self.tree.rank(symbol, hi)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (which, lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the text to a sampled suffix."""
        out, steps, left = np.zeros_like(rows), np.zeros_like(rows), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            there = self.marked[rows[left]]
            got = left[there]
            out[got] = self.sample[self.nth[rows[got]]] + steps[got]
            left = left[~there]
            symbol, nth = self.tree.access(rows[left])
            rows[left] = self.before[symbol] + nth
            steps[left] += 1
        return out


def search_shard(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence of the phrases in a shard's documents."""
    none = np.empty(0, np.int64)
    if not len(words) or not len(phrases.length):
        return none, none
    h = words.hashes()
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == h
    symbol = np.where(known, at + 2, 1)
    head = np.zeros(len(words), bool)
    head[words.first[:-1][np.diff(words.first) > 0]] = True
    # A separator stands before each known word that follows an unknown one or begins a document.
    split = known & (head | ~np.append(False, known[:-1]))
    word = np.flatnonzero(known)
    if not len(word):
        return none, none
    size = 1 + split[word]
    place = np.cumsum(size) - 1
    text = np.ones(int(place[-1]) + 2, np.int64)
    text[place], text[-1] = symbol[word], 0
    origin = np.zeros(len(text), np.int64)
    origin[place] = word
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    which, lo, hi = index.search(phrases)
    if not len(which):
        return none, none
    total = hi - lo
    rows = np.repeat(lo - (np.cumsum(total) - total), total) + np.arange(int(total.sum()))
    return np.repeat(which, total), origin[index.locate(rows)]


_SCHEMA = "_k long, doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, words): the word hashes of items, long ones cut where windows begin; equal rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, bounds in text_chunks(batch):
                words = Words(data, bounds, ALNUM_BYTES, lower=True)
                h = words.hashes().view(np.int64)
                sizes = np.diff(words.first)
                cuts = np.where(sizes > 0, np.maximum(1, -(-(sizes - window + 1) // PIECE)), 0)
                item = np.repeat(np.arange(words.n_docs), cuts)
                nth = np.arange(len(item)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first = words.first[item] + nth * PIECE
                stop = np.minimum(first + PIECE + window - 1, words.first[item + 1])
                size = stop - first
                take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(h[take]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + item)), lists], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "item string, words array<long>").distinct()


def _phrases(pieces: DataFrame, window: int) -> Phrases:
    got = pieces.toArrow()
    lists = got["words"].combine_chunks()
    bounds = np.append(0, np.cumsum(np.array(lists.value_lengths(), np.int64)))
    return Phrases(got["item"].to_pylist(), lists.flatten().to_numpy().view(np.uint64), bounds, window)


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch, limit=SHARD_BYTES):
                words = Words(data, bounds, ALNUM_BYTES, lower=True)
                which, at = search_shard(words, phrases)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + phrases.length[which], -1)
                hit = np.cumsum(edge)[:-1] > 0
                begins = hit.copy()
                begins[1:] &= ~hit[:-1] | (words.doc[1:] != words.doc[:-1])
                first = np.flatnonzero(begins)
                ends = hit.copy()
                ends[:-1] &= ~hit[1:] | (words.doc[1:] != words.doc[:-1])
                last = np.flatnonzero(ends)
                own = words.doc[first]
                n_spans = np.bincount(own, minlength=words.n_docs)
                base = words.first[own]
                spans = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["first", "last"])
                n_items = phrases.item_at[which + 1] - phrases.item_at[which]
                each = np.repeat(phrases.item_at[which] - (np.cumsum(n_items) - n_items), n_items) + np.arange(int(n_items.sum()))
                pairs = np.unique(np.repeat(words.doc[at], n_items) * len(phrases.ids) + phrases.items[each]) if len(which) else np.empty(0, np.int64)
                items = [[] for _ in range(words.n_docs)]
                for d, i in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(phrases.ids)))), strict=True):
                    items[d].append(phrases.ids[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.diff(words.first)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_spans))), pa.int32()), spans),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["_k", "doc_id", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(released(run), _SCHEMA)


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(_k, doc_id, n_words, spans, items) of each document: word spans inside occurrences, merged.

    A window is `window` consecutive words of an item; a shorter item with words is one window. spans
    are (first, last) word numbers from 0. Null texts have no words. Items with a null item_id still
    mark spans, but can't be listed; a repeated item_id is listed once. An empty benchmark marks none.
    Every document row gives one row, repeated ones too, whatever the size of the benchmark.
    """
    docs = keyed(documents)
    pieces = materialize(_pieces(benchmark, window), "pieces")
    words = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-words // BLOCK_WORDS))
    if blocks == 1:
        return _search(docs, _phrases(pieces, window))
    block, parts = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)), []
    for b in range(blocks):  # a block's windows leave the driver before the next one comes
        hits = _search(docs, _phrases(pieces.where(block == b), window)).where(F.size("spans") > 0)
        parts.append(materialize(hits.select("_k", "spans", "items").dropDuplicates(["_k"]), "hits"))
    # A key stands for every row of the same doc_id and text: hits are merged per key, and each row takes its key's.
    found = reduce(DataFrame.unionByName, parts).groupBy("_k")
    found = found.agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    step = "aggregate(spans, cast(array() as array<struct<first:long,last:long>>), (a, s) -> if(size(a) > 0 and element_at(a, -1).last + 1 >= s.first, concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, s.last)))), concat(a, array(s))))"
    each = _search(docs, _phrases(pieces.limit(0), window)).select("_k", "doc_id", "n_words").join(found.withColumn("spans", F.expr(step)), "_k", "left")
    none = {"spans": "array<struct<first:long,last:long>>", "items": "array<string>"}
    return each.select("_k", "doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))
