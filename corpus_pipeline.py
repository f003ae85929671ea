"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

A stage takes and returns the columns of documents; others are left out. Null, empty and repeated rows are
documents like any others; where a stage treats them apart, its docstring says so. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.base import discard, doc_key, materialize, recorded, table
from vecspark.llm.fmindex import contaminated_spans
from vecspark.llm.langid import identify, learn_languages
from vecspark.llm.lines import line_dedup
from vecspark.llm.queries import tokens
from vecspark.llm.simhash import simhash_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Shingles and differing bits at which near_dedup links fingerprints. A five-word Jaccard similarity of 0.8 gives
#: about 10 bits in the mean and one of 0.9 about 6: wider budgets make every key too short to be selective.
SHINGLE, BUDGET = 5, 7


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_k", doc_key())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letters, or a score under the calibrated threshold.

    Where no document has a language, none can be learnt, and only documents without letters go.
    """
    model = learn_languages(docs, F.lit(True))
    bad = materialize(identify(docs, model).where("rejected").select("_k").distinct(), "rejected")
    return _own(docs).join(bad, "_k", "left_anti").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace texts by their lines that stay; a document that loses its last word so goes, and n_chars follows."""
    found = line_dedup(docs).where("n_dropped > 0").select("_k", "kept").dropDuplicates(["_k"])
    out = _own(docs).join(found, "_k", "left").withColumn("text", F.coalesce("kept", "text"))
    out = out.where(F.col("kept").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each near-duplicate class one document: that with the smallest doc_id, and of several rows with
    this doc_id the one with the smallest key, once, with its least (lang, source, n_chars).

    Fingerprints of five-word shingles link at up to BUDGET bits. Documents without words stay, all of them, as
    they have no fingerprint to be told by, and so do documents without doc_id, as a class is named by one.
    """
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = simhash_components(docs.where(has_words), shingle=SHINGLE, budget=BUDGET).where("doc_id is not null")
    first = found.where("doc_id = component_id").groupBy("component").agg(F.min("_k").alias("first"))
    stays = materialize(first.select(F.col("first").alias("_k"), F.lit(True).alias("first")), "kept")
    told = has_words & F.col("doc_id").isNotNull()
    rows = _own(docs).withColumn("told", told).join(stays.hint("merge"), "_k", "left").where(~F.col("told") | F.col("first"))
    once = rows.where("told").groupBy("_k", "doc_id").agg(F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return once.select("doc_id", "text", "rest.*").select(*COLUMNS).unionByName(rows.where(~F.col("told")).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null texts hold none."""
    found = contaminated_spans(docs, table(spark, sf_dir, "benchmark"))
    hit = materialize(found.where(F.size("spans") > 0).select("_k").distinct(), "contaminated")
    return _own(docs).join(hit, "_k", "left_anti").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_valid): the tokens of each text, decoded by a stream."""
    return tokens(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenise),
]

#: Stages 1 and 5 have no SQL: tests/llm/test_pipeline.py compares each stage and the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next.

    What a stage wrote for itself, and its input, go as soon as its output is written; the last stage is lazy,
    and its input stays until the session ends.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        discard(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
