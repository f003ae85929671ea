"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import substring_dedup
from .base import table
from .bpe import PATTERN, round_trip
from .fmindex import contaminated_spans
from .langid import identify, learn_languages
from .lines import line_dedup
from .media import compose_pages, media_store, parse_sequences, read_back, resolve
from .simhash import simhash_components
from .sparse_sa import suffix_array_dedup
from .toxicity import learn_toxicity, toxicity
from .warc import fixity_audit, merkle_trees, warc_leaves


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of pages in which the records with certain url hashes were damaged or lost."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1)
    replica = pages.where(mark != "a").withColumn("html", F.when(mark == "3", F.concat("html", F.lit("\x00"))).otherwise(F.col("html")))
    found = fixity_audit(*merkle_trees(warc_leaves(pages), warc_leaves(replica)))
    return found.select("file", "page_id", "offset", "length", "digest", "replica_digest", "status")


def _deduplicated(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduplicated(substring_dedup(table(spark, sf_dir, "documents"), window=35))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduplicated(suffix_array_dedup(table(spark, sf_dir, "documents"), window=50))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    media = read_back(media_store(documents))
    parts = resolve(parse_sequences(compose_pages(documents), "page"), media).where("kind = 'media'")
    return parts.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "position")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=4, seed=42, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn_toxicity(documents, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    found = toxicity(documents, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn_languages(documents, ~held_out(3, 1) & F.col("doc_id").isNotNull())
    return identify(documents, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_valid) of each text."""
    out = round_trip(documents, tokenizer_path(), PATTERN)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("valid").alias("decoded_valid"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def _passages_sql(window: int) -> str:
    """Words of windows whose word sequence also starts elsewhere, by the windows as strings."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - {window} + 2)) AS i FROM d WHERE len(w) >= {window}),
g AS (SELECT s.r, i, array_to_string(w[i : i + {window} - 1], ' ') AS g FROM s JOIN d ON s.r = d.r),
twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS pos FROM g SEMI JOIN twice ON g.g = twice.g),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
marked AS (SELECT words.r, word, words.pos, gone.r IS NOT NULL AS out, lag(gone.r IS NOT NULL, 1, false) OVER (PARTITION BY words.r ORDER BY words.pos) AS before FROM words LEFT JOIN gone ON words.r = gone.r AND words.pos = gone.pos),
kept AS (SELECT r, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT before) AS n_spans, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT out), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans FROM d LEFT JOIN kept ON d.r = kept.r"""


QUERIES = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL = {
    "op1_warc_fixity": r"""
WITH r AS (SELECT page_id, url, md5(coalesce(url, '')) AS m,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head, coalesce(html, '') AS body, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM pages),
w AS (SELECT page_id, m, head || strlen(body)::VARCHAR || gap || body || gap AS rec, head || (strlen(body) + 1)::VARCHAR || gap || body || chr(0) || gap AS bad FROM r),
o AS (SELECT page_id, m, page_id // 256 AS file, strlen(rec) AS length, sha256(rec) AS digest, sha256(bad) AS bad_digest FROM w),
p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM o)
SELECT file, page_id, "offset", length, digest, CASE WHEN m LIKE '3%' THEN bad_digest END AS replica_digest, CASE WHEN m LIKE '3%' THEN 'corrupt' ELSE 'missing' END AS status
FROM p WHERE m LIKE '3%' OR m LIKE 'a%'""",
    "op2_substring_dedup": _passages_sql(35),
    "op3_suffix_array_dedup": _passages_sql(50),
    "op5_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bi),
di AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
o AS (SELECT di.r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM di JOIN d ON di.r = d.r),
h AS (SELECT r, i, o.n, item_id FROM o JOIN p ON o.g = p.g AND o.n = p.n),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN named ON d.r = named.r""",
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, d.key IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
