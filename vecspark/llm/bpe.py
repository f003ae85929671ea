"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

The merges decide, for each prefix of a piece, one last token; a token t may follow a token p
only if merging their bytes gives back (p, t). So a left-to-right machine needs to remember the
longest suffix that may still grow into a token and the last tokens at the boundaries inside it.
These finite states and their byte transitions are made when first met and kept; the machine is
linear in the bytes, however long a piece is, where merging by rank is quadratic. A boundary is
emitted once every boundary a later token can start from traces back through it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import kept, released

#: Entries kept by a worker for whole pieces (in each of two generations), machine states and pairs of
#: tokens whose boundary was judged; beyond these the older generation, the machine or the pairs start anew.
PIECES, STATES, CHECKED = 150_000, 200_000, 250_000
#: Pending bytes after which a long piece looks for tokens that are settled.
LOOKAHEAD = 256


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The defining procedure: join the adjacent pair of least rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
        if least == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


#: The public pattern of this vocabulary, and the same language for texts of these characters
#: only, where the standard library's faster matcher agrees with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_unusual = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f\u00a1\u00ab\u00bb\u00bf{_LETTERS}\u2010-\u2027]").search
_usual = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+").findall


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.plain = ranks, regex.compile(pattern).findall, pattern == PATTERN
        self.token = {i: b for b, i in ranks.items()}
        self.open = {b[:n] for b in ranks for n in range(1, len(b))}  # what may grow into a token
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[int, bool] = {}
        #: The tokens of whole pieces, as the bytes of 32-bit integers: small, and quick to join.
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state: its transitions so far by byte, its window, and the last token at each boundary of
        #: the window from which a token may still grow (-2 at the others, -1 at the piece's start).
        self.start = ({}, b"", (-1,))
        self.index = {(b"", (-1,)): self.start}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: None for a byte, and (-1, -1) if no merge does."""
        if token not in self.splits:
            data = self.token[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                least, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if least == 1 << 40 or least == token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = None if len(data) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.splits[token]

    def _own(self, token: int) -> bool:
        return self._split(token) != (-1, -1)

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether merging leaves the boundary between two tokens alone.

        Their last merges are undone from the latest on; while a left part x and a right part y
        stand at the boundary, they would merge if x + y comes before the merge just undone.
        """
        if before < 0:
            return self._own(token)
        ok = self.follows.get(before << 20 | token)
        if ok is not None:
            return ok
        ok, x, y, limit = self._own(token) and self._own(before), before, token, 1 << 40
        while ok:
            joined = self.ranks.get(self.token[x] + self.token[y])
            if joined is not None and joined < limit:
                ok = False
                break
            left, right = self._split(x), self._split(y)
            if left and (not right or x > y):
                limit, x = x, left[1]
            elif right:
                limit, y = y + 1, right[0]  # of two equal merges the left one comes first
            else:
                break
        if len(self.follows) > CHECKED:
            self.follows.clear()
        self.follows[before << 20 | token] = ok
        return ok

    def _step(self, state: tuple, byte: int) -> tuple:
        """Make the transition of a state on a byte: the next state and the last token there."""
        window, lasts, token = state[1] + bytes((byte,)), [], None
        rank, growing, follows = self.ranks.get, self.open, self.follows.get
        first = len(window)
        for i, before in enumerate(state[2]):
            if before != -2:
                tail = window[i:] if i else window
                if token is None and (t := rank(tail)) is not None:
                    ok = follows(before << 20 | t) if before >= 0 else None
                    if ok or ok is None and self._may_follow(before, t):
                        token = t
                if tail not in growing:
                    before = -2
                elif i < first:
                    first = i
            lasts.append(before)
        if token is None:
            raise ValueError("the ranks can't spell this text")
        key = (window[first:], (*lasts[first:], token))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = ({}, *key)
        out = state[0][byte] = (to, token)
        return out

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece, each as soon as no later byte can change it."""
        if len(self.index) > STATES:
            self._reset()
        state, lasts, base, size = self.start, [-1], 0, self.token
        for n, byte in enumerate(data, 1):
            state, token = state[0].get(byte) or self._step(state, byte)
            lasts.append(token)
            if n - base >= LOOKAHEAD and not n % 64:
                # every token to come starts at a boundary in the window; where these meet is settled
                at = {n - len(state[1]) + i for i, last in enumerate(state[2]) if last != -2}
                while len(at) > 1 and max(at) > base:
                    last = max(at)
                    at.remove(last)
                    at.add(last - len(size[lasts[last - base]]) if last > base else base)
                settled = max(at)
                if settled > base:
                    yield from self._trace(lasts, settled - base)
                    lasts, base = lasts[settled - base :], settled
        yield from self._trace(lasts, len(data) - base)

    def _trace(self, lasts: list[int], n: int) -> list[int]:
        out = []
        while n > 0:
            out.append(lasts[n])
            n -= len(self.token[lasts[n]])
        return out[::-1]

    def tokens(self, text: str) -> Iterator[int]:
        """The tokens of a text as they settle: of a long piece before its end is read."""
        for piece in _usual(text) if self.plain and not _unusual(text) else self.find(text):
            if len(piece) < LOOKAHEAD // 4:
                yield from array("i", self.pieces.get(piece) or self.piece(piece))
            else:
                yield from self.stream(piece.encode())

    def piece(self, text: str) -> bytes:
        if len(self.pieces) >= PIECES:
            self.older = dict(self.pieces)
            self.pieces.clear()
        if text in self.older:
            ids = self.pieces[text] = self.older[text]
            return ids
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            found = [whole]
        elif len(data) < LOOKAHEAD:
            if len(self.index) > STATES:
                self._reset()
            state, lasts = self.start, [-1]
            for byte in data:
                state, token = state[0].get(byte) or self._step(state, byte)
                lasts.append(token)
            found = self._trace(lasts, len(data))
        else:
            found = self.stream(data)
        ids = array("i", found).tobytes()
        if len(data) < LOOKAHEAD:
            self.pieces[text] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The tokens of a text as the bytes of 32-bit integers."""
        known, make = self.pieces.get, self.piece
        return b"".join([known(p) or make(p) for p in (_usual(text) if self.plain and not _unusual(text) else self.find(text))])

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


class Utf8Machine:
    """An incremental UTF-8 validator: state 0 is between characters, -1 is an error."""

    def __init__(self) -> None:
        self.state, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> bool:
        for b in data:
            if self.state == 0:
                self.low, self.high = 0x80, 0xBF
                if b < 0x80:
                    continue
                if 0xC2 <= b <= 0xDF:
                    self.state = 1
                elif 0xE0 <= b <= 0xEF:
                    self.state, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
                elif 0xF0 <= b <= 0xF4:
                    self.state, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
                else:
                    self.state = -1
            elif self.state > 0 and self.low <= b <= self.high:
                self.state, self.low, self.high = self.state - 1, 0x80, 0xBF
            else:
                self.state = -1
            if self.state < 0:
                return False
        return True

    @property
    def complete(self) -> bool:
        return self.state == 0


class Decoder:
    """The table of tokens' bytes that streams of ids are decoded by."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values(), default=-1) + 1
        self.token = [b""] * n
        for b, i in ranks.items():
            self.token[i] = b
        self.length = np.array([len(b) for b in self.token], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1])).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.alone = np.zeros(n, bool)
        for i, b in enumerate(self.token):
            m = Utf8Machine()
            self.alone[i] = m.feed(b) and m.complete

    def bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()

    def stream(self) -> Stream:
        return Stream(self)


class Stream:
    """Incremental decoding: ids come in runs, and whole characters go out as soon as their bytes are there.

    The UTF-8 machine's state goes over from token to token and from run to run. A token that is whole
    characters leaves the machine where it was, so it is stepped through only inside or after a character that
    tokens share; bytes of an open character wait in `pending`. After an error, bytes go out unchecked.
    """

    def __init__(self, decoder: Decoder):
        self.decoder, self.machine, self.pending, self.valid = decoder, Utf8Machine(), b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes that are settled after these ids."""
        data = self.pending + self.decoder.bytes(ids)
        if self.valid:
            machine, token, last = self.machine, self.decoder.token, -1
            for i in np.flatnonzero(~self.decoder.alone[ids]).tolist():
                # a whole character may not come inside an open one; an open one ends in the next token
                if not machine.complete and i != last + 1 or not machine.feed(token[ids[i]]):
                    self.valid = False
                    break
                last = i
            if self.valid and not machine.complete and last != len(ids) - 1:
                self.valid = False
        open_ = 0 if not self.valid or self.machine.complete else self._open(data)
        self.pending = data[len(data) - open_ :]
        return data[: len(data) - open_]

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end belong to a character that isn't whole."""
        return next(n for n in range(1, 4) if data[-n] >= 0xC0)

    def end(self) -> bytes:
        """What is left of an open character, which makes the stream invalid."""
        rest, self.pending = self.pending, b""
        self.valid = self.valid and not rest
        return rest


def _vocabulary(path: str) -> tuple[str, dict[bytes, int]]:
    """A digest of a file of ranks, and the ranks."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest(), load_ranks(path)


def _machine(kind: type, shared, *more: str):
    """This worker's encoder or decoder of a vocabulary; it outlives a task, until another operator runs here."""
    digest, ranks = shared.value
    key = (kind, digest, *more)
    if key not in kept:
        for other in [k for k in kept if k[0] is kind]:  # one vocabulary at a time
            del kept[other]
        kept[key] = kind(ranks, *more)
    return kept[key]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


#: Characters of text encoded before a batch is sent on.
SEND = 2 << 20


def _encoded(machine: Transducer, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, ids, bounds of each row's ids) of runs of texts."""
    at = 0
    while at < len(texts):
        out, chars, first = [], 0, at
        while at < len(texts) and chars < SEND:
            text = texts[at].as_py() or ""
            out.append(machine.packed(text))
            chars, at = chars + len(text), at + 1
        bounds = np.append(0, np.cumsum([len(x) for x in out])) // 4
        yield first, at, np.frombuffer(b"".join(out), np.int32), bounds


#: Ids that a stream takes at once.
RUN = 1 << 16


def _decoded(machine: Decoder, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """The bytes of each row's ids by a stream of its own, and whether they are whole UTF-8."""
    out, valid = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        stream = machine.stream()
        parts = [stream.feed(ids[i : min(b, i + RUN)]) for i in range(a, b, RUN)]
        out.append(b"".join([*parts, stream.end()]))
        valid.append(stream.valid)
    return [pa.array(out, pa.binary()), pa.array(valid, pa.bool_())]


_ID, _IDS = T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))
_BACK = [T.StructField("decoded", T.BinaryType()), T.StructField("valid", T.BooleanType())]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the tokens of each whole text; null and empty texts have none.

    Every row gives one row, repeated ones and those without doc_id too; other columns are left out. The vocabulary is broadcast: a file of a fixed size, about 1 MB.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(Transducer, shared, pattern)
        for batch in batches:
            for lo, hi, ids, bounds in _encoded(machine, _column(batch, "text")):
                yield pa.RecordBatch.from_arrays([_column(batch, "doc_id").slice(lo, hi - lo), _lists(ids, bounds)], ["doc_id", "ids"])

    return _texts(documents).mapInArrow(released(run, keeps=True), T.StructType([_ID, _IDS]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Replace `ids` by `decoded` (binary) and `valid`: whether it is whole UTF-8; null ids are empty.

    Every row gives one row; other columns are passed through. Bytes that aren't UTF-8 are returned as they are.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_vocabulary(path))
    others = [f for f in encoded.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(Decoder, shared)
        for batch in batches:
            lists = _column(batch, "ids")
            bounds = np.append(0, np.cumsum(np.array(lists.value_lengths().fill_null(0), np.int64)))
            values = lists.flatten().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SEND // 4, "right")) - 1)
                back = _decoded(machine, values[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at])
                yield pa.RecordBatch.from_arrays([*(_column(batch, f.name).slice(at, stop - at) for f in others), *back], [*(f.name for f in others), "decoded", "valid"])
                at = stop

    return encoded.mapInArrow(released(run, keeps=True), T.StructType([*others, *_BACK]))


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded, valid): each whole text encoded, and its ids decoded, in one pass.

    As decode(encode(...)), but ids don't go to the JVM and back, and an executor has one worker a core
    instead of two, each with half the memory. The decoder sees nothing but the ids. Nulls and repeated rows
    are as in encode.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _machine(Transducer, shared, pattern), _machine(Decoder, shared)
        for batch in batches:
            for lo, hi, ids, bounds in _encoded(encoder, _column(batch, "text")):
                yield pa.RecordBatch.from_arrays([_column(batch, "doc_id").slice(lo, hi - lo), _lists(ids, bounds), *_decoded(decoder, ids, bounds)], ["doc_id", "ids", "decoded", "valid"])

    return _texts(documents).mapInArrow(released(run, keeps=True), T.StructType([_ID, _IDS, *_BACK]))
