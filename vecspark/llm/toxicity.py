"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

Features are the presence of hashed words and word beginnings. A bounded sample of labelled rows
gives, first, the features whose rates differ between the labels by more than chance, and then the
weights: log loss, a ridge, and a penalty on the squared change of the score when the identity terms
of a labelled text are swapped for others of their language or left out, or a mention is added to a
text without one. So a neutral mention of a group has no weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ALNUM_BYTES, Words, bounded_sample, keyed, mix, released, text_chunks

#: About so many labelled documents, and bytes of their texts, are read for training, however many there are; at
#: most twice as many come. Texts over LONGEST bytes are left out of the sample.
SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 8000, 24 << 20, 1 << 20
#: Bytes of the word beginnings that are features beside whole words.
HEADS = (4, 5, 6)
FEATURES, SIGNIFICANT, LEAST_DOCS = 512, 4.5, 3
#: Terms of each language that are swapped in the counterfactuals, for one of the same language.
IDENTITIES = {
    "en": ("women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "atheists", "immigrants", "refugees", "foreigners", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "arab", "african", "european", "american", "disabled", "deaf", "blind", "elderly", "young", "poor"),
    "de": ("frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "atheisten", "einwanderer", "flüchtlinge", "ausländer", "schwule", "lesben", "schwarze", "weiße", "asiaten", "araber", "afrikaner", "behinderte", "gehörlose", "blinde", "alte", "arme"),
    "fr": ("femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "athées", "immigrés", "réfugiés", "étrangers", "homosexuels", "lesbiennes", "noirs", "blancs", "asiatiques", "arabes", "africains", "handicapés", "sourds", "aveugles", "vieux", "pauvres"),
    "es": ("mujeres", "hombres", "niñas", "niños", "musulmanes", "cristianos", "judíos", "ateos", "inmigrantes", "refugiados", "extranjeros", "homosexuales", "lesbianas", "negros", "blancos", "asiáticos", "árabes", "africanos", "discapacitados", "sordos", "ciegos", "ancianos", "pobres"),
}
#: A term's languages, and what stands for a word in the features (see ALNUM_BYTES).
_TERMS = {t: tuple(x for x, own in IDENTITIES.items() if t in own) for own in IDENTITIES.values() for t in own}
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
FAIRNESS, RIDGE, STEPS = 2.0, 1e-3, 400


def features_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the words and word beginnings of a byte buffer, repeats included."""
    words = Words(data, bounds, ALNUM_BYTES, lower=True)
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, docs = [words.hashes()], [words.doc]
    full = words.ends
    for n in HEADS:
        long = full - words.starts > n
        words.ends = np.minimum(full, words.starts + n)
        hashes.append(mix(words.hashes()[long] + np.uint64(n)))
        docs.append(words.doc[long])
    words.ends = full
    return np.concatenate(hashes), np.concatenate(docs)


def _presence(texts: list[bytes], known: np.ndarray) -> np.ndarray:
    """The documents' 0/1 rows over known (sorted) features."""
    out = np.zeros((len(texts), len(known)), np.float32)
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        h, d = features_of(np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in part]))))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.empty(0, np.int64)
        if len(known):
            hit = known[at] == h
            out[i + d[hit], at[hit]] = 1
    return out


def swap_identity(text: str, to: str | Callable[[str], str]) -> str:
    """text with each identity term replaced by `to`, or by what it gives for the term; an empty one leaves it out.

    Terms are whole words as the features see them, so punctuation beside a term stays where it is.
    """

    def swap(m: re.Match) -> str:
        word = m.group().lower()
        return (to if isinstance(to, str) else to(word)) if word in _TERMS else m.group()

    return _WORD.sub(swap, text)


def names_identity(text: str) -> bool:
    return any(w in _TERMS for w in set(_WORD.findall(text.lower())))


@dataclass
class ToxicityModel:
    known: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        z = np.full(n, self.bias)
        if len(self.known):
            h, d = features_of(data, bounds)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = np.flatnonzero(self.known[at] == h)
            pairs = np.unique(d[hit] * len(self.known) + at[hit])
            z += np.bincount(pairs // len(self.known), weights=self.weight[pairs % len(self.known)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _select(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features whose rates in toxic and other documents differ beyond chance."""
    sets = []
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        h, d = features_of(np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in part]))))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.empty(0, bool)
        sets.append((h[once], y[i + d[once]]))
    if not sets:
        return np.empty(0, np.uint64)
    found, inverse = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    n = np.bincount(inverse, minlength=len(found))
    hot = np.bincount(inverse, weights=np.concatenate([t for _, t in sets]), minlength=len(found))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    rate = n / (n1 + n0)
    z = (hot / n1 - (n - hot) / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((np.abs(z) >= SIGNIFICANT) & (n >= LEAST_DOCS))
    return np.sort(found[good[np.argsort(-np.abs(z[good]), kind="stable")][:FEATURES]])


def train(texts: list[str], labels: list[int], seed: int = 5) -> ToxicityModel:
    y = np.array(labels, np.float64)
    raw = [t.encode() for t in texts]
    terms = [t.encode() for t in _TERMS]
    h, which = features_of(np.frombuffer(b"".join(terms), np.uint8), np.append(0, np.cumsum([len(t) for t in terms])))
    known = np.unique(np.concatenate((_select(raw, y), h)))
    x = _presence(raw, known)
    rng = np.random.default_rng(seed)
    term_rows = np.zeros((len(terms), len(known)), np.float32)
    term_rows[which, np.searchsorted(known, h)] = 1
    # Counterfactuals of every text of the sample: a group's name swapped or left out, or else a mention added.
    named = np.array([names_identity(t) for t in texts], bool)
    pick = lambda own: str(rng.choice(("", *(t for t in IDENTITIES[own[int(rng.integers(len(own)))]]))))
    other = [swap_identity(t, lambda term: pick(_TERMS[term])).encode() for t, has in zip(texts, named, strict=True) if has]
    gap = np.empty_like(x)
    gap[named] = x[named] - _presence(other, known)
    rest = np.flatnonzero(~named)
    gap[rest] = x[rest] - np.maximum(x[rest], term_rows[rng.integers(len(terms), size=len(rest))])
    w, b = np.zeros(len(known)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    # the rarer class weighs more, as if it were 15 % of the rows; beyond that, chance features would cost clean texts
    rare = max(0.15, min(0.85, y.mean() if len(y) else 0.5))
    weight = np.where(y > 0, 0.5 / rare, 0.5 / (1 - rare))
    # full-batch descent with per-weight steps (Adam)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        error = weight * (p - y) / max(1, len(y))
        g = x.T @ error + RIDGE * w + FAIRNESS * gap.T @ (gap @ w) / max(1, len(gap))
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.05 * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(known, w, float(b))


def learn_toxicity(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, longest: int = LONGEST) -> ToxicityModel:
    """Fit on about `rows` of the labelled documents where `learn` (on doc_id) holds, of about `size` bytes at most.

    The sample is the documents with the smallest hashes of doc_id and text, whole texts of up to `longest` bytes
    each; rows that repeat a document are one. Labels are first cut to about 4 * rows doc_ids by hash, so that
    they are broadcast to the scans of the documents. A doc_id with labels of both kinds counts as toxic; null
    doc_ids and labels teach nothing. Without labels every score is one half.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    n = marks.select("doc_id").distinct().count()
    if n > 4 * rows:
        marks = marks.where(F.xxhash64(F.lit(7), "doc_id") < F.lit(int(-(1 << 63) + (1 << 64) * 4 * rows / n)))
    picked = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    got = bounded_sample(texts.select(F.xxhash64(F.lit(5), "doc_id", "text").alias("h"), "text", "toxic"), rows, size, longest)
    if not got:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), 0.0)
    return train([r.text for r in got], [int(r.toxic > 0) for r in got])


def toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(_k, doc_id, score) of every whole text, a row for each row; null and empty texts score as without features."""
    docs = keyed(documents)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(shared.value.scores(data, bounds))], ["_k", "doc_id", "score"])

    return docs.mapInArrow(released(run), "_k long, doc_id long, score double")
