"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into a ring of M = T + 1 segments. If two differ in at most T bits, some start of
the ring has, for every length l up to M, at most l*T/M differing bits in its first l segments
(the strong form of the pigeonhole principle). So the first segment agrees, of the second at most one
bit differs, of the third at most two, and of a segment with at most d one of d + 1 parts agrees.
Keys of (start, such parts of the first segments) find the candidates; a key takes in more segments as
there are more fingerprints. The budgets of longer chains prune these before the full Hamming distance.

Equal fingerprints are one row from the start, and a key's group gives a spanning forest of its
links, not its pairs. Large groups are dealt out as pairs of blocks over many tasks.

Tables here grow with the documents and pack well in files, so that Spark would take them for small and build them on
the driver to broadcast them: joins are merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, keyed, materialize, released, text_chunks
from .components import components

BITS = 64
#: Fingerprints that may agree in a key by chance before keys take in one more segment, and segments of a key.
CHANCE, DEEPEST = 64, 4
#: Fingerprints of a key that one task compares; a larger group is dealt out by pairs of blocks.
BLOCK = 4096


def fingerprints_of(data: np.ndarray, bounds: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The uint64 SimHash of each document of a byte buffer."""
    w = Words(data, bounds, lower=True)
    joined, starts, ends = w.joined()
    raw = joined.tobytes()
    sizes = np.diff(w.first)
    counts = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    total = int(counts.sum())
    out = np.zeros(w.n_docs, np.uint64)
    if not total:
        return out
    begin = np.cumsum(counts) - counts
    head = np.repeat(w.first[:-1] - begin, counts) + np.arange(total)
    last = np.minimum(head + shingle, np.repeat(w.first[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(raw[a:b], seed) for a, b in zip(starts[head].tolist(), ends[last].tolist(), strict=True)], np.uint64, total)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(counts)
    ones = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(documents: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(_k, doc_id, fp): a signed 64-bit fingerprint of each text; texts without words have 0."""
    docs = keyed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch):
                fp = fingerprints_of(data, bounds, shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(fp)], ["_k", "doc_id", "fp"])

    return docs.mapInArrow(released(run), "_k long, doc_id long, fp long")


def _segments(n: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(budget: int, depth: int = 2) -> list[tuple[int, int]]:
    """(start, mask) of the exact parts by which linked fingerprints meet, from the first `depth` segments."""
    n = budget + 1
    if not 0 < budget < BITS // 4:
        raise ValueError(f"a budget is from 1 to {BITS // 4 - 1} bits")
    parts, out = _segments(n), []
    for i in range(n):
        masks = [_mask(*parts[i])]
        for l in range(1, min(depth, n)):
            lo, hi = parts[(i + l) % n]
            spare = (l + 1) * budget // n  # differing bits the chain, so this segment, may have
            cuts = [lo + (hi - lo) * j // (spare + 1) for j in range(spare + 2)]
            masks = [m | _mask(a, b) for m in masks for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out += [(i, m) for m in masks]
    return out


def key_depth(n: int, budget: int) -> int:
    """How many segments keys take in so that, of n fingerprints, about CHANCE or fewer meet in one by chance."""
    depth = min(2, budget + 1)
    while depth < min(DEEPEST, budget + 1) and n > CHANCE << min(m.bit_count() for _, m in _keys(budget, depth)):
        depth += 1
    return depth


def links_within(key: np.ndarray, fp: np.ndarray, start: np.ndarray, side: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Forest of the links among equal neighbouring keys (rows sorted by key), and the pairs tested.

    side: 0 for a whole group; 1 and 2 for the two blocks of a pair, of which only links across count.
    """
    n = budget + 1
    parts = _segments(n)
    chain = np.array([[_mask(*parts[(i + l) % n]) for l in range(n)] for i in range(n)], np.uint64)
    parent = np.arange(len(key))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, tested, step = [], [], 0, 1
    label = parent.copy()
    at = np.arange(len(key))
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        i = at if not side.any() else at[(side[at] == 0) | (side[at] != side[at + step])]
        tested += len(i)
        x = fp[i] ^ fp[i + step]
        rows, differ = start[i], np.zeros(len(i), np.int64)
        for l in range(n):  # the last length is the full Hamming check
            differ += np.bitwise_count(x & chain[rows, l])
            ok = differ <= (l + 1) * budget // n
            i, x, rows, differ = i[ok], x[ok], rows[ok], differ[ok]
        i = i[label[i] != label[i + step]]
        for a in i.tolist():
            p, q = root(a), root(a + step)
            if p != q:
                parent[max(p, q)] = min(p, q)
                left.append(a)
                right.append(a + step)
        if len(i):
            label = parent[parent]
            while (label != parent[label]).any():
                label = parent[label]
        step += 1
    return np.array(left, np.int64), np.array(right, np.int64), tested


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, cut so that no key goes across two tables."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        g = t["g"].to_numpy()
        if len(g) == 0:
            continue
        cut = int(np.searchsorted(g, g[-1], "left")) if g[0] != g[-1] else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest


def fingerprint_links(fps: DataFrame, budget: int = 4, block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """(u, v) links of a column fp of distinct fingerprints: enough to connect all within budget bits.

    The links connect the same fingerprints whatever the depth of the keys (by default key_depth of their number).
    """
    keys = _keys(budget, depth or key_depth(fps.count(), budget))
    entry = [F.struct(F.lit(j).alias("j"), F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for j, (s, m) in enumerate(keys)]
    rows = fps.select("fp", F.explode(F.array(*entry)).alias("e")).select("fp", "e.*")
    sizes = materialize(rows.groupBy("j", "part").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    rows = rows.join(sizes.hint("merge"), ["j", "part"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A row of block b goes to the pairs (b, c) for every c, so each pair of blocks meets once.
    rows = rows.withColumn("b", own).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("c"), 0).when(F.col("b") < F.col("c"), 1).otherwise(2)
    rows = rows.select("fp", "start", side.cast("byte").alias("side"), F.xxhash64("j", "part", F.least("b", "c"), F.greatest("b", "c")).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            fp, g = t["fp"].to_numpy(), t["g"].to_numpy()
            a, b, _ = links_within(g, fp.view(np.uint64), t["start"].to_numpy(), t["side"].to_numpy(), budget)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(released(run), "u long, v long")


def simhash_components(documents: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(_k, doc_id, fp, component, component_id): near-duplicate classes of documents.

    component is a fingerprint that tells a class apart, as doc_ids may repeat. component_id is the smallest doc_id whose fingerprint is reachable by links of at most budget
    differing bits. Null doc_ids come last: a class of only these has a null component_id. Rows that
    repeat a document are linked with it.
    """
    marked = materialize(simhash(documents, shingle, seed), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(fingerprint_links(fps.select("fp"), budget))
    classed = fps.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = materialize(classed.join(least.hint("merge"), "component").select("fp", "component", "component_id"), "classes")
    return marked.join(by_fp.hint("merge"), "fp").select("_k", "doc_id", "fp", "component", "component_id")
