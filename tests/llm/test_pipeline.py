"""The corpus pipeline: each stage and the whole against brute force, on a table and on awkward rows."""

import collections

import pytest
import tiktoken

pytest.importorskip("vecspark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402
from test_brute import ALNUM, DATA, SPACES, UPPER, awkward, sha  # noqa: E402

from vecspark.llm import queries as Q  # noqa: E402
from vecspark.llm.base import shared_dir  # noqa: E402
from vecspark.llm.bpe import PATTERN, load_ranks  # noqa: E402
from vecspark.llm.langid import learn_languages  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LAST = (1 << 63) - 1


def rejected(model, text):
    """By the model's table, one subword at a time."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return True
    if model is None:
        return False
    total, n = [0.0] * len(model.languages), 0
    for word in SPACES.findall(text.translate(UPPER)):
        raw = b" " + word.encode() + b" "
        for size in (2, 3, 4):
            for i in range(len(raw) - size + 1):
                code = raw[i]
                for b in raw[i + 1 : i + size]:
                    code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
                row = model.table[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 17]
                total, n = [t + float(x) for t, x in zip(total, row, strict=True)], n + 1
    z = [(t / max(1, n) + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return max(e) / sum(e) < model.threshold


def brute_language(rows, model):
    return [r for r in rows if not rejected(model, r[1])]


def brute_lines(rows):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UPPER)
    held, out = collections.defaultdict(set), []
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(LAST if d is None else d)
    for d, t, lang, source, n in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (LAST if d is None else d)]
        if len(kept) == len(own):
            out.append((d, t, lang, source, n))
        elif SPACES.search("\n".join(kept)):
            out.append((d, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def brute_near(rows):
    """Rows of each class's smallest doc_id, as sets of candidates: which row of one doc_id stays is the operator's."""
    import xxhash

    def fp(t):
        w = SPACES.findall(t.translate(UPPER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    told = [r for r in rows if r[0] is not None and SPACES.search(r[1] or "")]
    prints = [fp(r[1]) for r in rows if SPACES.search(r[1] or "")]
    owner = [r[0] for r in rows if SPACES.search(r[1] or "")]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 7:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(owner):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = collections.Counter(least.values())
    return [r for r in rows if r not in told], want


def brute_clean(rows, items):
    windows = set()
    for _, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        windows.update(tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9) if w else 0))
    sizes = {len(w) for w in windows}

    def hit(t):
        w = ALNUM.findall((t or "").translate(UPPER))
        return any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def table_of(spark, tmp_path, kind):
    """documents with extra columns of clashing names, and a benchmark."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).collect()
    rows = [tuple(r) for r in docs] if kind != "empty" else []
    if kind in ("awkward", "unlabelled"):
        rows = rows[:60] + rows[:3] + [(d, t, None if i % 3 else "en", None, len(t) if t is not None else None) for i, (d, t) in enumerate(awkward())]
        rows += [(rows[5][0], rows[5][1] + " x", "en", "s", 1), (None, rows[6][1], None, None, None)]
    if kind == "unlabelled":
        rows = [(a, b, None, d, e) for a, b, _, d, e in rows]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()] if kind != "empty" else []
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("_k", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("score", F.lit(0.5)).withColumn("first", F.lit(False))
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items, str(tmp_path)


@pytest.mark.parametrize("kind", ["table", "awkward", "unlabelled", "empty"])
def test_stages_and_run(spark, tmp_path, kind):
    rows, items, d = table_of(spark, tmp_path, kind)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    count = collections.Counter

    def after(name, now):
        got = stages[name](spark, now, d)
        if name != "byte_bpe":
            assert got.columns == corpus_pipeline.COLUMNS
        return spark.createDataFrame(rows_ := [tuple(r) for r in got.collect()], SCHEMA), rows_

    now, got = after("language_id", docs)
    want = brute_language(rows, learn_languages(docs, F.lit(True)))
    assert count(got) == count(want) and (kind == "empty" or got)
    now, got = after("line_dedup", now)
    assert count(got) == count(brute_lines(want))
    before = got
    now, got = after("simhash_near_dedup", now)
    untold, classes = brute_near(before)
    told = [r for r in got if r not in untold]
    assert count(r[0] for r in told) == classes and set(told) <= set(before) and count(r for r in got if r in untold) == count(untold)
    before = got
    now, got = after("decontamination", now)
    assert count(got) == count(brute_clean(before, items))
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(Q.tokenizer_path()), special_tokens={})
    last = count()
    for r in got:
        ids = own.encode_ordinary(r[1] or "")
        last[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(r[1] or ""), True)] += 1
    assert count(tuple(r) for r in stages["byte_bpe"](spark, now, d).collect()) == last
    assert count(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == last


def test_wordless_documents_and_repeats_in_the_near_dedup_stage(spark):
    rows = [(1, None, "a", "s", None), (2, "", None, "s", 0), (3, " \n", "a", None, 2), (4, "one two", "b", "s", 7), (4, "one two", "a", "t", 7), (4, "one other", "a", "s", 9), (5, "one two", "c", "s", 7), (None, "one two", "c", "s", 7)]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = collections.Counter(tuple(r) for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == collections.Counter([*rows[:3], (4, "one two", "a", "t", 7), (4, "one other", "a", "s", 9), rows[7]])


def test_run_leaves_only_its_last_tables(spark, tmp_path):
    from pathlib import Path

    _, _, d = table_of(spark, tmp_path, "awkward")
    here = Path(shared_dir(spark).removeprefix("file://"))
    before = set(here.iterdir())
    corpus_pipeline.run(spark, d).collect()
    assert sorted(p.name.split("-")[0] for p in set(here.iterdir()) - before) == ["decontamination"]


def test_near_dedup_broadcasts_nothing_from_the_driver(spark, monkeypatch):
    import corpus_pipeline
    from vecspark.llm import components as C
    from vecspark.llm import simhash as H

    plans = []

    def kept(df, name="stage", write=H.materialize):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    for module in (C, H, corpus_pipeline):
        monkeypatch.setattr(module, "materialize", kept)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2} eight nine ten", "en", "web", 40) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    last = corpus_pipeline.near_dedup(spark, docs, "")
    plans.append(last._jdf.queryExecution().sparkPlan().toString())
    assert last.count() <= 4 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
