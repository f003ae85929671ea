"""Every text operator against a brute-force version, on the smallest tables and on awkward rows."""

import binascii
import collections
import hashlib
import re

import numpy as np
import pytest
import tiktoken
import xxhash

pytest.importorskip("vecspark.llm")

from pyspark.sql import functions as F  # noqa: E402

from vecspark.llm import queries as Q  # noqa: E402
from vecspark.llm.automaton import substring_dedup  # noqa: E402
from vecspark.llm.bpe import PATTERN, Decoder, Transducer, Utf8Machine, decode, encode, load_ranks, round_trip  # noqa: E402
from vecspark.llm.components import components  # noqa: E402
from vecspark.llm.fmindex import contaminated_spans  # noqa: E402
from vecspark.llm.langid import identify, learn_languages  # noqa: E402
from vecspark.llm.lines import line_dedup  # noqa: E402
from vecspark.llm.media import compose_pages, decode_png, encode_png, media_store, pad, parse_page, parse_sequences, read_back, resolve  # noqa: E402
from vecspark.llm.simhash import simhash_components  # noqa: E402
from vecspark.llm.sparse_sa import suffix_array_dedup  # noqa: E402
from vecspark.llm.toxicity import learn_toxicity, swap_identity, toxicity  # noqa: E402
from vecspark.llm.warc import fixity_audit, merkle_trees, warc_leaves  # noqa: E402

DATA = "/root/testdata/sf0.001"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def awkward():
    base = " ".join(f"w{i % 37}x{i % 11}" for i in range(120))
    near = base.replace("w5x5", "other")
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "one"), (7, "a b c"), (None, base), (7, "a b c"), (8, "   \t\n"),
        (9, "same " * 3000), (10, "same " * 3000 + "end"), (11, "line one is long\nline one is LONG \nb\n"), (12, "  Line one is long\nz"), (13, "É日本 🙂 é" * 40),
        (14, " ".join(f"u{i}" for i in range(30)) + " " + base), (15, " ".join(base.split()[:34])), (16, "x" * 50000), (17, "\x00\x1c weird\xa0 ½² ＡＢ"),
    ]


def rows(spark, which):
    if which == "empty":
        return []
    if which == "awkward":
        return awkward()
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, data):
    """documents with other columns that clash with the operators' own names."""
    return spark.createDataFrame([(a, b, 1, "x", 2, "y") for a, b in data], "doc_id long, text string, _k int, kept string, n long, pos string").repartition(3)


cases = pytest.mark.parametrize("which", ["awkward", "empty", "table"])


def brute_passages(data, window):
    words = [SPACES.findall(t or "") for _, t in data]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(data, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return collections.Counter(out)


@cases
@pytest.mark.parametrize(("operator", "window"), [(substring_dedup, 35), (suffix_array_dedup, 50), (substring_dedup, 12), (suffix_array_dedup, 12)])
def test_passages(spark, which, operator, window):
    data = rows(spark, which)
    got = Q._deduplicated(operator(frame(spark, data), window=window)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(data, window)


def test_passages_of_a_heavy_gram(spark, monkeypatch):
    from vecspark.llm import passages

    monkeypatch.setattr(passages, "HEAVY", 3)
    common = [f"c{i}" for i in range(20)]
    data = [(i, " ".join([f"l{i % 7}_{j}" for j in range(30)] + common + [f"r{i % 5}_{j}" for j in range(30)])) for i in range(40)]
    # a passage longer than a window, between words that differ in every document and in every few
    long = [f"p{i}" for i in range(45)]
    data += [(100 + i, " ".join([f"a{i}_{j}" for j in range(20)] + [f"b{i % 9}_{j}" for j in range(4)] + long + [f"d{i}_{j}" for j in range(20)])) for i in range(30)]
    for operator in (substring_dedup, suffix_array_dedup):
        got = Q._deduplicated(operator(frame(spark, data), window=35)).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(data, 35)


@cases
def test_lines(spark, which):
    data = rows(spark, which)
    lines = [(d, (t or "").split("\n")) for d, t in data]
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UPPER)
    held = collections.defaultdict(set)
    last = (1 << 63) - 1
    for d, own in lines:
        for x in own:
            if len(key(x)) >= 10:
                held[key(x)].add(last if d is None else d)
    want = []
    for d, own in lines:
        kept = [x for x in own if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (last if d is None else d)]
        want.append((d, len(own), len(own) - len(kept), sha("\n".join(kept))))
    got = line_dedup(frame(spark, data)).withColumn("h", F.sha2("kept", 256)).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.h) for r in got) == collections.Counter(want)


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_lines_of_more_documents(spark, which):
    data = [(i, f"shared by all of them\nshared by {i // 2} only") for i in range(6)]
    got = line_dedup(frame(spark, data), min_docs=3).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


ITEMS = [(1, " ".join(f"u{i}" for i in range(14))), (2, "One"), (3, None), (4, ""), (5, "w5x5 w6x6 w7x7"), (5, "w5x5 w6x6 w7x7"), (None, "w9x9 w10x10"), (30, " ".join(f"u{i}" for i in range(9, 20)))]


@cases
def test_decontamination(spark, which):
    data = rows(spark, which)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] if which == "table" else ITEMS if which == "awkward" else []
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(i)
    sizes = {len(w) for w in windows}
    want = []
    for d, t in data:
        w, hit, found = ALNUM.findall((t or "").translate(UPPER)), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        found = sorted(str(i) for i in found if i is not None)
        want.append((d, len(w), len(hit), len(found), sha(",".join(found)), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated_spans(frame(spark, data), bench)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    got = found.select("doc_id", "n_words", n_hit.alias("h"), F.size("items").alias("n"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("s")).collect()
    assert collections.Counter((*r, r.h > 0) for r in got) == collections.Counter(want)


def test_decontamination_by_blocks(spark, monkeypatch):
    from vecspark.llm import fmindex

    data = rows(spark, "awkward")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    look = lambda: sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], sorted(r["items"])) for r in contaminated_spans(frame(spark, data), bench).collect())
    whole = look()
    monkeypatch.setattr(fmindex, "PIECE", 2)
    assert look() == whole
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 9)
    assert [(a, b, sum(y - x + 1 for x, y in c), d) for a, b, c, d in look()] == [(a, b, sum(y - x + 1 for x, y in c), d) for a, b, c, d in whole]


def test_decontamination_by_blocks_keeps_repeated_rows(spark, monkeypatch):
    from vecspark.llm import fmindex

    data = awkward() + awkward()[15:16] * 3 + [(4, None), (5, "")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    look = lambda: collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(sorted(r["items"]))) for r in contaminated_spans(frame(spark, data), bench).collect())
    whole = look()
    assert whole.total() == len(data) and max(n for (_, _, spans, _), n in whole.items() if spans) == 4
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 9)
    assert look() == whole


def brute_fingerprint(text):
    w = SPACES.findall((text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@cases
def test_simhash(spark, which):
    data = rows(spark, which)
    fps = [brute_fingerprint(t) for _, t in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = collections.Counter((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(data))
    got = simhash_components(frame(spark, data)).collect()
    assert collections.Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == want


def test_links_of_close_fingerprints_in_blocks(spark):
    from vecspark.llm.simhash import fingerprint_links

    rng = np.random.default_rng(2)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for x in rng.integers(0, 1 << 62, 6) for _ in range(60)]
    near = sorted(set(near))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for block, budget, depth in ((4096, 4, None), (16, 4, None), (4096, 4, 4), (4096, 7, 2), (16, 7, 3)):
        links = fingerprint_links(spark.createDataFrame([(sign(x),) for x in near], "fp long"), budget, block, depth)
        got = {r.node: r.component for r in components(links).collect()}
        label = {x: x for x in near}
        for _ in range(12):
            for a in near:
                for b in near:
                    if (a ^ b).bit_count() <= budget:
                        label[a] = label[b] = min(label[a], label[b], key=sign)
        pairs = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
        assert {p for p in pairs({sign(k): sign(v) for k, v in label.items()}) if len(p) > 1} == {p for p in pairs(got) if len(p) > 1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@cases
def test_bpe(spark, which):
    data = rows(spark, which)
    path = Q.tokenizer_path()
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    got = encode(frame(spark, data), path, PATTERN).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == collections.Counter((d, tuple(own.encode_ordinary(t or ""))) for d, t in data)


@cases
def test_bpe_decodes_in_one_pass_as_in_two(spark, which):
    data = rows(spark, which)
    path = Q.tokenizer_path()
    one = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded), r.valid) for r in round_trip(frame(spark, data), path, PATTERN).collect())
    assert collections.Counter({(d, b, v): n for (d, _, b, v), n in one.items()}) == collections.Counter((d, (t or "").encode(), True) for d, t in data)
    ids = spark.createDataFrame([(d, list(i)) for d, i, _, _ in one.elements()] + [(50, None)], "doc_id long, ids array<int>")
    two = collections.Counter((r.doc_id, bytes(r.decoded), r.valid) for r in decode(ids, path).collect())
    assert two == collections.Counter([(d, b, v) for d, _, b, v in one.elements()] + [(50, b"", True)])


def test_bpe_query(spark):
    data = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in Q.op10_byte_bpe(spark, DATA).collect():
        assert r.decoded_sha256 == sha(data[r.doc_id]) and r.decoded_valid


def test_bpe_of_two_vocabularies_of_one_size(spark, tmp_path):
    import base64

    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string").coalesce(1)
    single = [bytes([i]) for i in range(256)]
    for name, pair, want in (("a", b"ab", [256, 99]), ("b", b"bc", [97, 256])):
        (tmp_path / name).write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate([*single, pair])))
        for found in (encode(docs, str(tmp_path / name), PATTERN), round_trip(docs, str(tmp_path / name), PATTERN)):
            assert sorted((r.doc_id or 0, list(r.ids)) for r in found.collect()) == [(0, []), (1, want), (1, want)]


def test_bpe_decodes_a_stream_of_ids():
    ranks = load_ranks(Q.tokenizer_path())
    machine, decoder = Transducer(ranks, PATTERN), Decoder(ranks)
    text = "é日本 🙂 naïve 𝕏 " * 20 + "x" * 700
    ids = list(machine.tokens(text))
    assert ids == machine.encode(text)
    for run in (1, 2, 3, 1000):
        stream, out = decoder.stream(), b""
        for i in range(0, len(ids), run):
            out += stream.feed(np.array(ids[i : i + run]))
            assert out.decode() is not None and text.encode().startswith(out)  # only whole characters go out
        assert out + stream.end() == text.encode() and stream.valid
    for bad in ([0xC3], [0xC3, 0x41], [0x80], [0xE2, 0x82, 0xC3]):
        stream = decoder.stream()
        got = b"".join(stream.feed(np.array([ranks[bytes([b])]])) for b in bad) + stream.end()
        assert got == bytes(bad) and not stream.valid


def test_bpe_streams_long_pieces():
    path = Q.tokenizer_path()
    machine = Transducer(load_ranks(path), PATTERN)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    rng = np.random.default_rng(0)
    for text in ("ab" * 5000, "".join(rng.choice(list("etaoinshr"), 9000)), "<|endoftext|>" * 30, "-" * 3001):
        assert machine.encode(text) == own.encode_ordinary(text)
    long = "".join(rng.choice(list("etaoinshr"), 9000)).encode()
    stream, fed = machine.stream(iter_bytes := bytes(long)), 0
    first = next(stream)
    assert machine.token[first] == iter_bytes[: len(machine.token[first])] and fed == 0


@pytest.mark.parametrize("data", [b"", "é日🙂".encode(), b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xe2\x82", b"\xf4\x90\x80\x80", b"a\x80"])
def test_utf8_machine(data):
    m = Utf8Machine()
    ok = all(m.feed(data[i : i + 1]) for i in range(len(data))) and m.complete
    try:
        data.decode()
    except UnicodeDecodeError:
        assert not ok
    else:
        assert ok


@cases
def test_media(spark, which):
    data = rows(spark, which)
    docs = frame(spark, data)
    parts = resolve(parse_sequences(compose_pages(docs), "page"), read_back(media_store(docs))).where("kind = 'media'").collect()
    want = []
    for d, t in data:
        raw = (t or "").encode()
        full = pad(raw)
        image = encode_png(full)
        assert len(full) % 64 == 0 and full and decode_png(image) == full
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), binascii.crc32(full[-64:]), len(image), hashlib.sha256(image).hexdigest(), f"document {'without id' if d is None else d}"))
    assert collections.Counter((r.page.doc_id, r.page.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.caption) for r in parts) == collections.Counter(want)


def test_html_sequences(spark):
    parts = parse_page("<article><p>a &amp; b</p><script>x<y</script><figure><img src='sha256:ab' alt='alt'><figcaption>cap</figcaption></figure><img src='u.png' alt='v'>tail")
    assert parts == [["text", "a & b", None, None], ["media", "sha256:ab", "ab", "cap"], ["media", "u.png", None, "v"], ["text", "tail", None, None]]
    assert parse_page(None) == [] and parse_page("") == []
    found = parse_sequences(spark.read.parquet(f"{DATA}/pages.parquet"), "page_id")
    assert found.groupBy("page_id").agg((F.max("position") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    with pytest.raises(ValueError):
        decode_png(encode_png(pad(b"abc"))[:-20] + b"0" * 20)


def test_language_id(spark):
    r = Q.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97 and r.score.between(0, 1).all() and r.rejected.mean() < 0.02


def test_language_id_awkward(spark):
    docs = frame(spark, awkward() + [(99, "12 34 !!")]).withColumn("lang", F.when(F.col("doc_id") < 12, "aa").otherwise("bb"))
    got = identify(docs, learn_languages(docs, F.lit(True))).collect()
    assert len(got) == len(awkward()) + 1
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got if r.doc_id in (4, 5, 8, 99))
    none = identify(docs, learn_languages(docs, F.lit(False)))
    assert {(x.lang_pred, x.score) for x in none.collect()} == {("und", 0.0)}
    assert {x.doc_id for x in none.where("rejected").collect()} == {4, 5, 8, 99}
    assert identify(docs.limit(0), None).count() == 0


def test_toxicity(spark):
    path = "/root/testdata/sf0.1"
    r = Q.op7_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").toPandas()
    found, toxic = r.predicted == 1, r.toxic == 1
    # 7 of 97 toxic labels are on texts without any word that marks the others
    assert (found & toxic).sum() / toxic.sum() > 0.92 and (found & toxic).sum() / found.sum() > 0.95
    assert (found == (r.score >= 0.5)).all() and r.score.between(0, 1).all()


def _with_tables(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_scores_see_neither_held_out_labels_nor_other_columns(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    other = docs.withColumn("source", F.lit("x")).withColumn("n_chars", F.lit(0))
    bent = _with_tables(spark, tmp_path / "a", documents=other.withColumn("lang", F.lit("zz")), labels=labels.withColumn("toxic", F.when(Q.held_out(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    score = lambda q, where: {r.doc_id: r.score for r in q(spark, where).collect()}
    assert score(Q.op7_toxicity, d) == score(Q.op7_toxicity, bent)
    bent = _with_tables(spark, tmp_path / "b", documents=other.withColumn("lang", F.when(Q.held_out(3, 1), F.lit("zz")).otherwise(F.col("lang"))))
    assert score(Q.op9_language_id, d) == score(Q.op9_language_id, bent)


def test_samples_are_bounded_whole_and_without_repeats(spark):
    from vecspark.llm.base import bounded_sample

    texts = [f"text {i} " * (i % 50) for i in range(2000)] + ["copy " * 100] * 3000 + ["long " * 40000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("h"), "text")
    got = [r.text for r in bounded_sample(rows, 100, 20_000, 100_000)]
    assert 0 < len(got) <= 200 and sum(map(len, got)) <= 40_000 and len(set(got)) == len(got) and set(got) <= set(texts[:-1])
    assert {r.text for r in bounded_sample(rows, 10_000, 1 << 30, 100_000)} == set(texts[:-1])
    assert bounded_sample(rows.limit(0), 1, 1, 1) == []


def test_toxicity_awkward(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        got = toxicity(docs, learn_toxicity(docs, marks, F.lit(True))).collect()
        assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)


def test_identity_terms_have_no_weight():
    from vecspark.llm.toxicity import train

    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words, 20))
        # the group is named mostly in toxic texts, as in biased samples
        text += (" vile" if toxic else "") + (" muslims" if toxic and i % 8 or i % 40 == 1 else "")
        texts.append(text)
        labels.append(int(toxic))
    model = train(texts, labels)
    one = lambda t: float(model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0])
    assert one("word1 word2 muslims word3") < 0.5 < one("word1 vile word3")
    assert abs(one("word1 muslims") - one("word1 women")) < 0.15
    assert swap_identity("the Muslims came", "jews") == "the jews came"
    assert swap_identity("Muslims, (women) and Männer! womenfolk", "x") == "x, (x) and x! womenfolk"


def audit(a, b):
    return fixity_audit(*merkle_trees(warc_leaves(a), warc_leaves(b)))


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(700)] + [(None, "n", "x"), (None, "m", None), (3, "u3", "<p>3</p>")], "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    assert audit(pages, pages).count() == 0
    assert audit(pages.limit(0), pages.limit(0)).count() == 0
    assert {r.status for r in audit(pages, pages.limit(0)).collect()} == {"missing"} and audit(pages.limit(0), pages).count() == 703
    replica = pages.where("page_id is null or page_id not in (5, 3)").withColumn("html", F.when(F.col("page_id") == 600, "bad").otherwise(F.col("html")))
    replica = replica.unionByName(pages.where("page_id = 3").limit(1)).unionByName(spark.createDataFrame([(9999, "e", "e")], "page_id long, url string, html string").withColumn("file", F.lit("")))
    got = audit(pages, replica).collect()
    assert sorted((r.page_id, r.status) for r in got) == [(3, "missing"), (5, "missing"), (600, "corrupt"), (9999, "extra")]


def test_fixity_of_repeated_and_large_page_ids(spark):
    big = (1 << 53) + 1
    rows = [(7, f"u{i % 40}", "x" * (i % 40)) for i in range(400)] + [(big, "a", "a"), (big + 1, "b", "b"), (-5, "c", "c")] + [(None, "n", "n")] * 5
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    leaves = warc_leaves(pages).collect()
    at = {}  # records of a file lie without gaps
    for r in sorted(leaves, key=lambda r: (r.file, r.page_id is None, r.page_id or 0, r.digest)):
        assert r.offset == at.get(r.file, 0)
        at[r.file] = r.offset + r.length * r.copies
    assert sum(r.copies for r in leaves) == len(rows) and {r.file for r in leaves if r.page_id in (big, big + 1)} == {big // 256, (big + 1) // 256}
    lost = [r for i, r in enumerate(rows) if not (r[0] == 7 and i >= 390)]
    got = audit(pages, spark.createDataFrame([*lost[:-8], (big, "a", "A"), *lost[-7:-2]], schema)).collect()
    assert collections.Counter((r.page_id, r.status) for r in got) == {(7, "missing"): 10, (big, "corrupt"): 1, (None, "missing"): 2}
    assert len({(r.file, r.offset) for r in got}) == len(got)


def test_fixity_reads_the_roots_of_an_intact_replica(spark):
    from vecspark.llm.base import discard, recorded

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    with recorded() as made:
        a, b = merkle_trees(warc_leaves(pages), warc_leaves(pages))
    roots = a.levels[-1].inputFiles() + b.levels[-1].inputFiles()
    discard(spark, [p for p in made if not any(p.rsplit("/", 1)[-1] in f for f in roots)])
    assert len(a.levels) > 2 and a.levels[-1].count() == 1 and fixity_audit(a, b).count() == 0
