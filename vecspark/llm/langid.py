"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained by mini-batch gradient descent in numpy on a bounded sample of labelled documents. The
subwords are byte n-grams that lie within a word and its two boundaries. Scores are calibrated by a
temperature, and rejection by a threshold, both fitted on a part of the sample kept from training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Words, bounded_sample, keyed, released, text_chunks

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: About so many labelled documents, and bytes of their texts, are read for training, however many there are; at
#: most twice as many come. Texts over LONGEST bytes are left out of the sample.
SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 2000, 16 << 20, 1 << 20
EPOCHS, BATCH, RATE = 8, 32, 0.5
#: Share of the calibration documents that rejection may cost, and the score at which it ends.
REJECTED, SURE = 0.002, 0.5
UNKNOWN = "und"


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every subword of a byte buffer."""
    words = Words(data, bounds, lower=True)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text, starts, _ = words.joined()
    text = np.concatenate((np.array([0x20], np.uint8), text))  # a blank before and after each word
    own = np.append(np.repeat(words.doc, np.diff(np.append(starts, len(text) - 1))), words.doc[-1])
    blank = text == 0x20
    code, buckets, docs = text.astype(np.uint32), [], []
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ text[n - 1 :]
        if n in GRAMS:
            inner = np.ones(len(code), bool)
            for i in range(1, n - 1):
                inner &= ~blank[i : i + len(code)]
            if n == 2:
                inner &= ~(blank[:-1] & blank[1:])
            at = np.flatnonzero(inner)
            buckets.append(((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
            docs.append(own[at])
    return np.concatenate(buckets), np.concatenate(docs)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # of each bucket, what it adds to each language's logit: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        buckets, docs = subwords(data, bounds)
        n, k = len(bounds) - 1, len(self.languages)
        sums = np.stack([np.bincount(docs, weights=self.table[buckets, j], minlength=n) for j in range(k)], axis=1) if len(buckets) else np.zeros((n, k))
        return sums / np.maximum(np.bincount(docs, minlength=n), 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, bounds) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    bags = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, counts = np.unique(subwords(raw, np.array([0, len(raw)]))[0], return_counts=True)
        bags.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    check = order[: max(1, len(order) // 5)]
    fit = order[len(check) :] if len(order) > len(check) else order
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)

    def shares(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            out[i, bags[r][0]] = bags[r][1]
        return out

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(fit), BATCH):
            rows = fit[i : i + BATCH] if epoch == 0 else rng.choice(fit, min(BATCH, len(fit)), replace=False)
            share = shares(rows)
            x = share @ embed
            error = softmax(x @ weight + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            back = error @ weight.T
            weight -= rate * (x.T @ error) / len(rows) * 8
            bias -= rate * error.mean(axis=0) * 0.1
            embed -= share.T @ (rate * 8 * back)
    model = LanguageModel(languages, (embed @ weight).astype(np.float32), bias, 1.0, 0.0)
    z = np.concatenate([shares(check[i : i + BATCH]) @ embed for i in range(0, len(check), BATCH)]) @ weight + bias
    losses = [(-np.log(np.maximum(softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean(), t) for t in np.geomspace(0.05, 5, 40)]
    model.temperature = float(min(losses)[1])
    best = softmax(z / model.temperature).max(axis=1)
    model.threshold = float(min(SURE, np.quantile(best, REJECTED)))
    return model


def learn_languages(documents: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, label: str = "lang", size: int = SAMPLE_BYTES, longest: int = LONGEST) -> LanguageModel | None:
    """Fit on about `rows` of the documents where `learn` holds and neither label nor text is null.

    The sample is those with the smallest hashes of doc_id, text and label, so it is the same in any order
    and partitioning; rows that repeat a document are one. It holds about `size` bytes at most, in whole texts
    of up to `longest` bytes each. None without labels.
    """
    known = documents.where(learn & F.col(label).isNotNull() & F.col("text").isNotNull())
    text, y = F.col("text").cast("string"), F.col(label).cast("string")
    got = bounded_sample(known.select(F.xxhash64(F.lit(9), "doc_id", text, y).alias("h"), text.alias("text"), y.alias("y")), rows, size, longest)
    return train([r.text for r in got], [r.y for r in got]) if got else None


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(_k, doc_id, lang_pred, score, rejected) of every whole text.

    A text that is null or has no letter is `und` with score 0, and rejected. rejected also holds where the
    calibrated score is under the model's threshold. Without a model every text is `und` with score 0, and only
    those without a letter are rejected: nothing was learnt that could reject the others. Rows that repeat a
    document give a row each.
    """
    docs = keyed(documents)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = np.array(batch.column(3).fill_null(False))
            for lo, hi, data, bounds in text_chunks(batch):
                if m is None:
                    best, names = np.zeros(hi - lo), np.full(hi - lo, UNKNOWN, object)
                else:
                    p = m.probabilities(data, bounds)
                    best, names = p.max(axis=1), np.array(m.languages, object)[p.argmax(axis=1)]
                unknown = ~letters[lo:hi]
                best = np.where(unknown, 0.0, np.clip(best, 0, 1))
                names[unknown] = UNKNOWN
                rejected = unknown | (best < (m.threshold if m else 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names.tolist(), pa.string()), pa.array(best), pa.array(rejected)], ["_k", "doc_id", "lang_pred", "score", "rejected"])

    return docs.withColumn("letters", F.col("text").rlike(r"\p{L}")).mapInArrow(released(run), "_k long, doc_id long, lang_pred string, score double, rejected boolean")
