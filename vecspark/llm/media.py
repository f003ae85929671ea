"""Media columns: interleaved document sequences with payloads kept by digest.

HTML parsing gives, in document order, text structs and media references; a reference holds the
digest of its payload and its caption. Payloads live once in a media store, a Parquet table in the
shared folder; they are stored as 8-bit grey PNG images of 64 columns. Features are computed from
the bytes read back there, and references resolve by a join on the digest, so no payload and no
text goes through a shuffle.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keyed, materialize, released

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_png(payload: bytes) -> bytes:
    """A grey image of WIDTH columns whose samples, row by row, are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    """The samples of an image made by encode_png; a damaged chunk is an error."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, height = 8, [], 0
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if binascii.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not a grey image of 64 columns")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean, spread and an 8 x 8 average hash of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = np.add.reduceat(x, np.arange(8) * len(x) // 8, axis=0, dtype=np.int64) if len(x) >= 8 else np.repeat(x.sum(axis=0, dtype=np.int64)[None], 8, axis=0)
    cells = bands.reshape(8, 8, 8).sum(axis=2)
    sizes = np.maximum(np.diff(np.append(np.arange(8) * len(x) // 8, len(x))), 1) if len(x) >= 8 else np.full(8, len(x))
    total, n = int(x.sum(dtype=np.int64)), x.size
    above = (cells * n > total * 8 * sizes[:, None]).ravel()
    histogram = np.bincount(x.ravel(), minlength=256)
    squares = int((histogram * np.arange(256, dtype=np.int64) ** 2).sum())
    return f"h={len(x)};mean={total * 1000 // n};var={(squares * n - total * total) // (n * n)};ahash={int.from_bytes(np.packbits(above).tobytes()):016x}"


def _payload(text: Column) -> Column:
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    zeros = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), zeros.cast("int"))))


def payload_digest(text: Column) -> Column:
    """The sha256 of a text's payload, without leaving the JVM."""
    return F.sha2(_payload(text), 256)


def compose_pages(documents: DataFrame) -> DataFrame:
    """(page, html): each document as a page, its lines as paragraphs and its payload as a figure.

    page is a struct of doc_id and n_bytes, the length of the text in UTF-8.
    """
    docs = keyed(documents)
    text = F.coalesce("text", F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.replace(safe, F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), payload_digest(F.col("text")), F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit("</figcaption></figure>"))
    page = F.struct("doc_id", F.octet_length(text).cast("long").alias("n_bytes"))
    return docs.select(page.alias("page"), F.concat(F.lit("<article><p>"), body, F.lit("</p>"), figure, F.lit("</article>")).alias("html"))


class _Sequence(HTMLParser):
    """Ordered (kind, text, digest, caption) parts of a page."""

    BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td th br figure nav footer header title body pre blockquote".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.run: list[str] = []
        self.skip, self.caption, self.figure = 0, None, None

    def _flush(self) -> None:
        text = "".join(self.run).strip()
        self.run = []
        if text:
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "video", "audio", "source"):
            self._flush()
            a = dict(attrs)
            src = a.get("src") or ""
            self.parts.append(["media", src, src[7:] if src.startswith("sha256:") else None, a.get("alt")])
            self.figure = self.parts[-1]
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in self.BLOCKS:
            self._flush()
            if tag == "figure":
                self.figure = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            if self.figure is not None:
                self.figure[3] = "".join(self.caption).strip()
            self.caption = None
        elif tag in self.BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skip:
            self.run.append(data)


def parse_page(html: str | None) -> list[list]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.parts


def parse_sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, kind, text, digest, caption): one row for each part of each page, in order.

    kind is "text" or "media"; a media row's text is its address and its digest is null when the
    address is not one of the store. Null or empty pages have no parts. A figure's caption belongs to
    the media before it in the figure, or else is its alt text.
    """
    field = pages.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, columns, size = batch.column(0).to_pylist(), 0, [[] for _ in range(6)], 0
            for at, text in enumerate(batch.column(1)):
                html_text = text.as_py()
                for position, part in enumerate(parse_page(html_text)):
                    for column, value in zip(columns, (keys[at], position, *part), strict=True):
                        column.append(value)
                size += len(html_text or "")
                if size > 4 << 20 or at == len(keys) - 1:
                    types = [batch.column(0).type, pa.int32(), *[pa.string()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "position", "kind", "text", "digest", "caption"])
                    columns, size = [[] for _ in range(6)], 0

    return pages.select(key, F.col(html).cast("string")).mapInArrow(released(run), f"`{key}` {field.dataType.simpleString()}, position int, kind string, text string, digest string, caption string")


def media_store(documents: DataFrame) -> DataFrame:
    """Write (digest, media) of every payload to the shared folder and return the table there.

    A task stores equal payloads once; copies in other tasks have equal rows.
    """
    docs = keyed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, media, size = [], [], 0
            for at, text in enumerate(batch.column(2)):
                payload = pad((text.as_py() or "").encode())
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest.hex())
                    media.append(encode_png(payload))
                    size += len(media[-1])
                if digests and (size > 4 << 20 or at == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])
                    digests, media, size = [], [], 0

    return materialize(docs.mapInArrow(released(run), "digest string, media binary"), "media")


def read_back(store: DataFrame) -> DataFrame:
    """Decode every stored payload, check it against its digest, and give its features, once a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = image.as_py()
                payload = decode_png(image)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"payload {digest} reads back as {sha}")
                rows.append((digest, len(payload), sha, binascii.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", "media").mapInArrow(released(run), schema).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Join media references with a table by digest; text rows and positions stay as they are.

    A reference without a row there keeps nulls. The table is written first: both sides then have
    plain exchanges, which AQE splits where one digest has many references.
    """
    there = materialize(media, "resolved")
    refs = sequences.where("kind = 'media'").join(there, "digest", "left")
    return sequences.where("kind <> 'media'").unionByName(refs, allowMissingColumns=True)
