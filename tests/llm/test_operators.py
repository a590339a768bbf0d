"""Each operator against brute force or its library, with nulls, ties, repeats, long and empty texts."""

import hashlib
import json
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from torqueline.llm import byte_bpe, chat_format, decontamination, fingerprints, language_id, near_dedup, personal_data, quality, repeated_spans, token_counts
from torqueline.llm.entry import multilingual_codec
from torqueline.llm import runtime
from torqueline.llm.runtime import components

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, sig binary, c string"
ALL_NULL = (None,) * 6


def corpus():
    """Small corpus with copies, near copies, hot passages, an id gap, unusual spaces and odd signs."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randrange(1000)}"
        texts[i] = " ".join(w)
    for i in range(60, 110):
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) + (f"\n{passage}" if i % 2 else "")
    texts |= {
        200: "", 201: None, 202: " \t\n ", 203: "One", 204: "one", 205: "a b c", 206: "A  B\tC", 207: "ha " * 3000, 208: "ha " * 2999 + "hi",
        209: "x" * 3_000_000, 210: "é è ü 😀  z " * 30, 211: passage, 212: passage.upper(), 213: "....", 214: "\x00\x1f a \x7f b",
    }
    return texts


def frame(spark, texts):
    rows = [(k, t, "en", "s", 1, "k", 1, b"x", "c") for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (20, 3)] + [(i, i + 1) for i in range(100, 160)] + [(900, 1000 + i) for i in range(50)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got[20] == got[1] == 1 and got[11] == 10 and 5 not in got and got[160] == 100 and got[1049] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, texts, size):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, size, 80).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute.near_duplicates(texts, size, 80).items()}


def test_near_duplicates_odd_rows(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None), (5, None), (5, None)]
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()), key=repr)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, None, True), (4, 0, 4, True), (5, 0, 5, True), (5, 0, 5, True)], key=repr)
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (4, ""), (5, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.create_map(F.lit("k"), F.lit(1)).alias("m"), F.lit("x").alias("k"), F.lit("y").alias("component_id"))
    kept = near_dedup.one_of_each(odd, 3)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (4, ""), (5, "")]
    assert near_dedup.one_of_each(odd.limit(0)).count() == 0


def test_sketches_of_borderline_pairs():
    """Of pairs with similarity 0.80 exactly, sketches rule out fewer than one in a thousand (none of 3000)."""
    rng = np.random.default_rng(3)
    sets = rng.integers(1, 2**63, (3000, 110), dtype=np.uint64)
    left, right = sets[:, :90].ravel(), sets[:, np.r_[:80, 90:100]].ravel()  # 80 in common of 100
    starts = np.arange(3000) * 90
    a, b = (near_dedup.mix(near_dedup.minhashes(x, starts)) & np.uint64(1) for x in (left, right))
    assert ((a != b).sum(1) <= near_dedup.MOST_BITS).all()


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeated_spans(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    monkeypatch.setattr(repeated_spans, "PIECE_WORDS", 2000)
    paths = repeated_spans.repeated_paths(docs)
    split = {k: brute.words(t) for k, t in texts.items()}
    seen = set()
    for r in paths.collect():
        a, b = (split[k][p : p + r.n + 12] for k, p in ((r.doc, r.pos), (r.src, r.spos)))
        assert r.src < r.doc and a == b and len(a) == r.n + 12
        assert not seen & (own := {(r.doc, r.pos + i) for i in range(r.n)})  # each window once
        seen |= own
    first = {}
    for k in sorted(split):
        for i in range(len(split[k]) - 12):
            first.setdefault(tuple(split[k][i : i + 13]), k)
    assert seen == {(k, i) for k, w in split.items() for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k}
    nodes = repeated_spans.branching_nodes(paths)
    assert nodes.agg(F.sum("entering") - F.sum("leaving")).first()[0] == 0
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_spans.without_repeats(docs).collect()}
    assert got == brute.repeated(texts)


def test_repeated_spans_odd_rows(spark, empty):
    assert repeated_spans.without_repeats(empty).count() == 0
    long = " ".join(map(str, range(20)))
    rows = [(None, long), (7, long), (7, long), (9, long + " end"), (8, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeated_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 20, 0), (7, 20, 0), (7, 20, 0), (8, 0, 0), (9, 21, 20)]
    other = " ".join(f"o{i}" for i in range(25))
    rows = [(1, long), (2, other), (2, long), (3, "x " + other), (3, long), (3, "short")]  # several texts a doc_id
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeated_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 20, 0), (2, 20, 20), (2, 25, 0), (3, 1, 0), (3, 20, 20), (3, 26, 25)]


def test_repeated_spans_without_broadcasts(docs, texts, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_spans.without_repeats(docs).collect()}
    assert got == brute.repeated(texts)


def test_repeated_spans_need_the_sources_words(spark, monkeypatch):
    """Where window hashes collide (all are made equal here), nothing goes whose words differ from the source's."""
    monkeypatch.setattr(repeated_spans, "window_hashes", lambda flat, size, seed: np.zeros(max(len(flat) - size + 1, 0), np.uint64))
    texts = {k: [f"{c}{i}" for i in range(30)] for k, c in ((1, "a"), (2, "b"), (3, "a"))}
    frame = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([" ".join(w) for w in texts.values()])], ["doc_id", "text"])
    rows = [b for b in repeated_spans._paths(13)(iter([frame]))]
    place = np.frombuffer(b"".join(x for b in rows for x, n in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True) if n < 0), repeated_spans._PLACE)
    assert set(place["src"]) == {1}  # by hash alone, documents 2 and 3 would lose all to document 1
    monkeypatch.undo()
    paths = spark.createDataFrame([(2, 0, 18, 1, 0), (3, 0, 18, 1, 0)], "doc long, pos int, n int, src long, spos int")
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    spans = docs.join(repeated_spans.verified(docs, paths).withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "text", "spans")
    got = {r.doc_id: r.n_removed for r in spans.mapInArrow(repeated_spans._cut(13), "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()}
    assert got == {1: 0, 2: 0, 3: 30}


def test_minimizer_counts_have_rare_ones():
    text = " ".join(f"w{i}" for i in range(13))
    piece = lambda *ids: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([text] * len(ids))], ["doc_id", "text"])
    found = [b for ids in ([1, 2], [3]) for b in repeated_spans._common(13)(iter([piece(*ids)]))]
    assert [b.column(1).to_pylist() for b in found] == [[2], [1]] and found[0].column(0) == found[1].column(0)


def test_contamination(spark, docs, texts, empty):
    items = {1: texts[211], 2: texts[211][:60].upper(), 10: "One", 3: None, 4: "...", 5: "never seen words", 6: "a b", 7: "a b", 8: "é è ü"}
    bench = spark.createDataFrame([*items.items(), (None, "one")], "item_id long, text string")
    want = brute.contamination(texts, items)
    got = {r.doc_id: tuple(r)[1:6] for r in decontamination.contamination(docs, bench).collect()}
    assert got == want
    left = {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()}
    assert left == {k for k, v in want.items() if not v[4]}
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    twice = spark.createDataFrame([(1, "one"), (1, "one"), (1, "two"), (None, "one"), (None, None)], "doc_id long, text string")
    assert sorted(tuple(r)[1:3] for r in decontamination.contamination(twice, bench).collect()) == [(0, 0), (1, 0), (1, 1), (1, 1), (1, 1)]  # a row each
    clash = twice.select("*", *[F.lit("x").alias(c) for c in ("version", "bad_id", "w", "n_hit")])
    left = decontamination.without_contaminated(clash, bench)
    assert left.columns == clash.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "two")]
    assert decontamination.without_contaminated(clash.limit(0), bench).count() == 0


def test_contamination_without_broadcasts(spark, monkeypatch):
    """Beyond the broadcast bound the same rows come out, and a word of the corpus travels about once."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == want
        tokens = decontamination.postings(docs, spark.createDataFrame([("the",)], "term string"), 1)
        plan = tokens._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Generate posexplode\(w#\d+\), \[doc_id#\d+L, version#\d+L, lead#\d+\], true", plan) and "Exchange" in plan  # no text goes on
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contamination_near(spark):
    texts = {1: "alpha x x x beta", 2: ", solo alone", 3: ", one two three new four new five", 4: "one two three", 5: "y y y y y y"}
    items = {1: "alpha beta", 2: "alpha y y y y", 3: "solo solo", 4: "one two three four five", 5: "y y"}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in decontamination.contamination(docs, bench).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}
    got = {(r.doc_id, r.item_id, r.start, r.end, r.kind) for r in decontamination.matches(docs, bench).collect()}
    assert got == {(3, 4, 4, 7, "near")} | {(5, 5, i, i + 2, "exact") for i in range(5)}


def test_languages(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "12 !", "en"), (None, "the and of that", None), (10**6 + 2, "É" * 600_000, None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(more)
    got = language_id.identify_languages(rows).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 4
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 0
    by = {r.doc_id: r for r in got}
    assert by[10**6].lang_pred == by[10**6 + 1].lang_pred == "und" and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify_languages(empty).count() == 0
    blind = language_id.identify_languages(rows.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in blind] == ["und"]
    stay = language_id.in_a_language(rows.withColumn("c1", F.lit(3)))
    assert stay.columns == ["doc_id", "text", "lang", "c1"] and stay.count() == docs.count() + 2 and stay.where("lang is null").count() == 0


def test_only_learned_languages_stay(spark):
    rows = [(i, "the cat and the dog are in the house", "en") for i in (0, 1, 2)]  # 5, 100 and 102 are held out
    rows += [(100, "привет мир", None), (5, "你好 世界", "en"), (102, "the house", None)]
    kept = language_id.in_a_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r.doc_id, r.lang) for r in kept.collect()} == {(i, "en") for i in (0, 1, 2, 102)}


def test_language_counts_match_brute_force():
    text = "Été, et l'été 42 à la mer"
    clean = " été et l été à la mer "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            g = clean[i : i + n]
            if g != " ":
                code = 0
                for c in g:
                    code = code << 21 | ord(c)
                want[code] = want.get(code, 0) + 1
    got = dict(zip(*map(lambda x: x.tolist(), language_id.gram_counts(text)), strict=True))
    assert got == want
    language_id.PIECE, old = 7, language_id.PIECE
    try:
        assert dict(zip(*map(lambda x: x.tolist(), language_id.gram_counts(text)), strict=True)) == want
    finally:
        language_id.PIECE = old


def test_quality(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(None, None), (None, ""), (10**6, "a" * 3_000_000)], "doc_id long, text string")
    got = quality.quality_scores(docs.select("doc_id", "text").union(more), labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg) > 0.95
    assert got.count() == docs.count() + 3 and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(more, labels.limit(0)).where("score = 0.5").count() == 3


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior_of_known_mixtures(share):
    rng = np.random.default_rng(1)
    draw = lambda n, at: rng.normal(at, 1, (n, 6)).astype(np.float32)
    n = int(3000 * share)
    unl = np.concatenate([draw(n, 1.5), draw(3000 - n, -1.5)])[rng.permutation(3000)]
    assert abs(quality.class_prior(draw(1500, 1.5), unl) - share) < 0.06
    assert quality.class_prior(draw(2, 0), unl) == 0.5


def test_quality_risk_by_differences():
    """Risk by its definition, text by text, and its gradient by differences; both where the second part is positive and where it is negative."""
    rng = np.random.default_rng(9)
    p, u = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (70, 6))
    net = quality.Network(np.zeros(6), np.ones(6), 3)
    net.w = [np.asarray(rng.normal(size=np.shape(w)), float) for w in net.w]

    def score(row):
        hidden = [math.tanh(sum(x * w for x, w in zip(row, net.w[0][:, k])) + net.w[1][k]) for k in range(len(net.w[1]))]
        return sum(h * w for h, w in zip(hidden, net.w[2])) + float(np.ravel(net.w[3])[0])

    def parts(prior):
        loss = lambda rows, sign: sum(math.log1p(math.exp(-sign * score(r))) for r in rows) / len(rows)
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    assert np.allclose([score(r) for r in u], net.logits(u)[0])
    signs = set()
    for prior in (0.05, 0.99, 5.0):  # the last is no probability, but makes the second part negative
        got = quality.risk_gradient(net, p, u, prior)
        first, second = parts(prior)
        signs.add(second >= 0)
        value = lambda: sum(parts(prior)) if second >= 0 else -parts(prior)[1]  # noqa: E731, B023
        for k, at in ((0, (2, 5)), (1, (3,)), (2, (7,)), (3, (0,))):
            was, ends = net.w[k][at], []
            for step in (1e-5, -1e-5):
                net.w[k][at] = was + step
                ends.append(value())
            net.w[k][at] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - got[k][at]) < 1e-6
    assert signs == {True, False}


def test_quality_over_all_rows(spark):
    """Without bounds every row is used; where there are fewer rows than the bounds that is the same."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "quality")))
    scores = lambda *bounds: {r.doc_id: r.score for r in quality.quality_scores(docs, labels, *bounds).collect()}
    want = scores()
    assert scores(None, None) == want and scores(60, 120) != want


def test_quality_takes_no_negative_labels(spark):
    """Scores are the same whatever the rows labelled 0 say, and for labels given twice."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "quality")))
    want = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    twice = labels.union(labels).where("quality = 1")
    assert {r.doc_id: r.score for r in quality.quality_scores(docs, twice).collect()} == want


@pytest.fixture(scope="module")
def codec():
    return multilingual_codec()


def test_byte_bpe(spark, docs, texts, codec, empty):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = {}
    for k, t in texts.items():
        ids = lib.encode_ordinary(t or "")
        want[k] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in byte_bpe.encoding_digests(docs, codec).collect()} == want
    assert byte_bpe.encoding_digests(empty, codec).count() == 0
    some = byte_bpe.encoded(docs.where("doc_id in (1, 201, 210)"), codec)
    assert {r.doc_id: r.ids for r in some.collect()} == {k: lib.encode_ordinary(texts[k] or "") for k in (1, 201, 210)}
    assert "n_tokens" in some.columns and "text" not in some.columns
    clash = byte_bpe.encoded(docs.where("doc_id in (1, 201)").withColumns({"Ids": F.lit("x"), "n_tokens": F.lit("y")}), codec)
    assert clash.schema["ids"].dataType.simpleString() == "array<int>" and clash.where("n_tokens = size(ids)").count() == 2 and "Ids" not in clash.columns
    assert byte_bpe.encoded(empty, codec).count() == 0


def test_byte_bpe_all_code_points(codec):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a".join(f"{p} 1{p}{p}'s {p}" for p in points[i : i + 512]) for i in range(0, len(points), 512)]
    ids, at = codec.encode(texts)
    assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == [lib.encode_ordinary(t) for t in texts]


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    assert byte_bpe.PerfectHash(keys)(keys).tolist() == list(range(5000))
    assert byte_bpe.PerfectHash([b"x"])([b"x"]).tolist() == [0]


def test_token_counts(spark, docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = token_counts._tokenizer(json.dumps(json.load(open(path))))
    more = {300: "<|endoftext|>" * 9 + " a<|endoftext|>b", 301: "word <|endoftext|> " * 20_000}
    want = {k: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for k, t in (texts | more).items() if k != 209}
    both = docs.where("doc_id <> 209").select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = token_counts.token_counts(both, path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(3000, 64), (500, 70), (150, 66), (130, 130)])
def test_resynchronisation(chunk, overlap):
    lib = token_counts._tokenizer(json.dumps(json.load(open(public_tokenizers.path("byte_bpe_50k.json")))))
    text = "a" * 900 + " " * 800 + "b1" * 300 + "<|endoftext|>" * 100 + " \n" * 300 + "é" * 500 + "some words, and more. " * 60
    for t in (text, text[::-1], "z" * 2000, "x", "", "one two " * 400, "don't  stop 12 345 " * 99):
        places = token_counts.chunk_places(len(t), chunk, overlap)
        assert places[0][0] == 0 and places[-1][1] == len(t) and all(b[0] == a[1] - overlap for a, b in zip(places, places[1:], strict=False))
        parts = [lib.encode(t[s:e], add_special_tokens=False) for s, e in places]
        assert token_counts.spliced_count(t, places, parts, lib) == len(lib.encode(t, add_special_tokens=False))


def test_token_counts_of_spliced_documents(spark):
    """One document in ten or more is spliced from several chunks, and all counts are the library's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = token_counts._tokenizer(json.dumps(json.load(open(path))))
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    assert sum(r.n_chunks > 1 for r in got.values()) * 10 >= len(got)
    assert all(got[r.doc_id].n_tokens == len(lib.encode(r.text or "", add_special_tokens=False)) for r in docs.collect())


PERSONAL = [
    "a@b@c.d x@a.b.@c.d y@a.b_y@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.255 1.2.3.0256 1..2.3.4", "4111 1111-1111 1111 4111  1111 1111 1111 4111111111111112 0000000000000",
    "+1 (017) 555-7713 +49 30 1234567. +12 +1234567890123456", "é+33 1 23 45 67 89é 😀 a.b@c-d.example.com", "1" * 3000 + " " + "1 " * 30000, "x" * 200_000 + "@" + "a." * 30000,
    None, "", "a@b.c," * 700, "+" * 1000 + "1" * 12, "9" * 100_000, "@" * 1000,
]


def test_personal_data(spark, empty):
    rows = list(enumerate(PERSONAL)) + [(None, "x@y.zz")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("email", F.lit("clash")).withColumn("n_chars", F.lit(None).cast("long"))
    for r in personal_data.personal_data(docs).collect():
        spans = brute.personal(PERSONAL[r.doc_id] if r.doc_id is not None else "x@y.zz")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in spans) for k in brute.PERSONAL)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert personal_data.personal_data(empty).count() == 0
    red = {r.doc_id: r for r in personal_data.redacted(docs).collect()}
    assert red[4].text == "é<PHONE>é 😀 <EMAIL>" and red[4].n_chars == 19 and red[4].email == "clash" and red[7].text is None and red[None].text == "<EMAIL>"


def test_personal_data_adds_spans(spark):
    clean = [(i, f"mail user{i}@mail{i}.com or +1 202 555 01{i:02d} now, code {10**14 + i}") for i in range(60)]
    docs = spark.createDataFrame([*clean, (99, "write to jo [at] site [dot] org, call 202-555-0143; no 12-34 here")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(docs).collect()}
    assert got[99] == "email:9:31,phone:38:50" and got[3].count(":") == 4


def test_personal_data_on_documents(spark):
    """Of the candidates in the table EM and the classifier accept some and reject some; what is added is checked one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: [x for x in f"{r.spans},{r.secret_spans}".split(",") if x] for r in personal_data.personal_data(docs).collect()}
    added, missed = set(), set()
    for r in docs.collect():
        base = {f"{k}:{s}:{e}" for k, s, e in brute.personal(r.text)}
        assert base <= set(got[r.doc_id])
        new = {tuple(x.split(":")) for x in set(got[r.doc_id]) - base}
        added |= {(k, r.text[int(s) : int(e)]) for k, s, e in new}
        secrets = {m.span() for m in re.finditer(r'(?i)(?<=token = ")[0-9a-f]{20,}', r.text or "")}
        assert secrets == {(int(s), int(e)) for k, s, e in new if k == "secret"}
        missed |= {m.group() for m in re.finditer(r"(?<![0-9.+-])[0-9]{16}(?![0-9.-])", r.text or "") if not brute.passes("card", m.group())}
    assert any(k == "secret" for k, _ in added)
    assert missed and not missed & {t for k, t in added if k == "card"}  # sixteen digits that fail the test


def test_personal_data_finds_loose_forms(spark):
    """Loosely written forms planted among the table's texts come back, at their places."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400)
    forms = {"email": "write to jo.ann{} [at] site [dot] org now", "phone": "call 202-555-01{:02d} today", "secret": 'api_key: "Zq{:02d}kd83hsYw6Tg2Lp0vN4xB" end'}
    rows = [(10**6 + 10 * i + j, "lorem " * i + text.format(i), kind) for i in range(20) for j, (kind, text) in enumerate(forms.items())]
    planted = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.spans + r.secret_spans for r in personal_data.personal_data(docs.union(planted)).collect()}
    inner = {"email": r"jo\.ann.* org", "phone": r"[0-9-]{12}", "secret": r"Zq\w+"}
    for i, text, kind in rows:
        m = re.search(inner[kind], text)
        assert got[i] == f"{kind}:{m.start()}:{m.end()}"


def test_personal_data_against_hard_negatives(spark):
    """Forms of all four kinds and secrets planted in the table's texts are found, what only looks like them is not; no length is too long."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    random_text = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n - 4)) + "aZ42"
    forms = [
        ("email", "mail me: ", lambda i: f"jo.ann{i} [at] corp [dot] com"), ("email", "so ", lambda i: f"{'x' * (60 + i)}(at)site.org"), ("email", "ask ", lambda i: f"kim{i} at dept dot uni dot edu"), ("email", "", lambda i: f"a{i}@b.org"),
        ("phone", "call me on ", lambda i: f"202-555-01{i:02d}"), ("phone", "phone: ", lambda i: f"(202) 555-01{i:02d}"), ("phone", "", lambda i: f"+49 30 12345{i:02d}"), ("ip", "host ", lambda i: f"10.1.2.{i}"), ("card", "card ", lambda i: "4111 1111 1111 1111"),
        ("secret", 'api_key: "', lambda i: random_text(30 + 12 * i)), ("secret", "password = ", lambda i: random_text(24)),
        (None, "commit ", lambda i: hexes(40)), (None, "md5 ", lambda i: hexes(32)), (None, "see ", lambda i: f"a-long-name-with-words-{i}"), (None, "number ", lambda i: f"411111111111{1000 + i * 10 + (3 if i % 10 != 5 else 4)}"),
    ]
    rows, want = [], {}
    for j, (kind, lead, form) in enumerate(forms):
        for i in range(20):
            k, text, front = 10**6 + 100 * j + i, form(i), "lorem " * i + lead
            if kind is None and brute.passes("card", text):
                continue
            rows.append((k, f"{front}{text} ende"))
            want[k] = (kind, f"{kind}:{len(front)}:{len(front) + len(text)}" if kind else "")
    got = {r.doc_id: r.spans + r.secret_spans for r in personal_data.personal_data(docs.union(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id >= 1000000").collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_personal_data_without_length_caps(spark):
    """Very long local parts, domains, dotted chains and secrets are one span each, or none, and end."""
    secret = "".join("aB3dE6gH9k"[i % 10] for i in range(100_000))
    texts = ["x" * 100_000 + " [at] " + "y" * 5000 + " [dot] com", "jo at a" + " dot bb" * 20_000, f'token = "{secret}"', "a" * 200_000, "a1/" * 60_000 + "@", " at " * 50_000]
    clean = [(100 + i, f"mail user{i}@mail{i}.com and +1 202 555 01{i:02d}, card 4111 1111 1111 1112 now") for i in range(60)]
    got = {r.doc_id: (r.spans, r.secret_spans) for r in personal_data.personal_data(spark.createDataFrame([*enumerate(texts), *clean], "doc_id long, text string")).where("doc_id < 100").collect()}
    assert got == {0: (f"email:0:{len(texts[0])}", ""), 1: (f"email:0:{len(texts[1])}", ""), 2: ("", "secret:9:100009"), 3: ("", ""), 4: ("", ""), 5: ("", "")}


def test_reliabilities_against_loops():
    """Expectation-maximisation again, vote by vote."""
    rng = np.random.default_rng(5)
    votes, counts = rng.integers(-1, 2, (30, 6)), rng.integers(1, 50, 30).astype(float)
    post = [(1 + sum(v == 1 for v in row)) / (2 + sum(v >= 0 for v in row)) for row in votes]
    for _ in range(100):
        yes, no = sum(c * p for c, p in zip(counts, post)), sum(c * (1 - p) for c, p in zip(counts, post))
        prior, after = (yes + 1) / (yes + no + 2), []
        said = {(j, k, v): sum(c * (p if k else 1 - p) for c, p, row in zip(counts, post, votes) if row[j] == v) + (personal_data.RIGHT if v == k else 1) for j in range(6) for k in (0, 1) for v in (0, 1)}
        for row in votes:
            like = [(1 - prior), prior]
            for j, v in enumerate(row):
                for k in (0, 1):
                    like[k] *= said[j, k, v] / (said[j, k, 0] + said[j, k, 1]) if v >= 0 else 1
            after.append(like[1] / sum(like))
        post = after
    got = personal_data.reliabilities(votes, counts)
    assert np.allclose(got[2], post, atol=1e-9) and abs(got[0] - prior) < 1e-9


def test_reliabilities():
    votes, counts = np.array([(1, 1, 1), (0, 0, 0), (1, 1, 0), (0, 0, 1), (-1, -1, 1)]), np.array([50.0, 50.0, 9.0, 9.0, 3.0])
    prior, rates, post = personal_data.reliabilities(votes, counts)
    assert 0.4 < prior < 0.6 and post[2] > 0.5 > post[3] and rates[0][1][2] > rates[2][1][2]
    assert len(personal_data.reliabilities(np.zeros((0, 5), int), np.zeros(0))[2]) == 0 and not personal_data.train_classifier(np.zeros((0, 3)), np.zeros(0), np.zeros(0)).any()


def test_fingerprints(spark, empty):
    rng = random.Random(2)
    texts = {i * 3: "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(9)) + "." for _ in range(rng.randint(0, 12))) for i in range(40)}
    texts |= {1000: "same\ntext", 1001: "same\ntext", 1002: "text\nsame", 1003: None, 1004: "😀é" * 50}
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    for i, k in enumerate(ids):
        x, y = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        cut = len(x) // 3
        edited = x[: len(x) - cut] + y[:cut]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[1000].fingerprint == got[1001].fingerprint == got[1002].fingerprint != got[1003].fingerprint
    assert got[1001].near_next == 1.0 and sum(got[k].near_edited > got[k].near_next for k in ids[5:]) >= 36
    assert fingerprints.fingerprints(empty).count() == 0
    odd = spark.createDataFrame([(None, "n"), (5, "b"), (5, "b"), (5, "c"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprints.fingerprints(odd).collect()) == [(0, 1), (5, 1), (5, 1), (5, 1), (7, 0)]
    assert fingerprints.fingerprints(odd.where("doc_id = 7")).first().near_next == 1.0


def test_fingerprints_are_sums(spark):
    rows = spark.createDataFrame([("a b c.\nd e f.", "a b c.", "d e f.")], "t string, x string, y string")
    q = rows.select(*[F.expr(f(c)).alias(f"{f.__name__[0]}{c}") for f in (fingerprints.equal_part, fingerprints.like_part) for c in "txy"]).first()
    assert list(q.et) == [(a + b) % 2**32 for a, b in zip(q.ex, q.ey, strict=True)] and list(q.lt) == [a + b for a, b in zip(q.lx, q.ly, strict=True)]


def test_fingerprints_take_paragraphs_in_and_out(spark):
    rows = spark.createDataFrame([("a b.\nc d!", "e f, g"), ("", "x"), ("one", ""), ("z", None)], "t string, p string")
    rows = rows.withColumn("u", F.concat("t", F.lit("\n"), F.coalesce("p", F.lit("")))).withColumn("v", F.concat(F.coalesce("p", F.lit("")), F.lit("\n"), "t"))
    made = rows.select("*", *[fingerprints.text_of(fingerprints.equal_part(c), fingerprints.like_part(c)).alias(f"f{c}") for c in "tuv"])
    for r in made.select("ft", "fu", "fv", fingerprints.inserted("ft", "p").alias("more"), fingerprints.deleted("fu", "p").alias("less")).collect():
        assert r.more == r.fu == r.fv and r.less == r.ft != r.fu


def test_fingerprints_without_exchange_reuse(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(7)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.id: r.prev_id for r in fingerprints.neighbours(docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("version"), F.lit(9).alias("chars"))).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {i: (i + 1) % 3000 for i in range(3000)}


def test_likeness_matches_brute_force(spark):
    """The cosine of the counters, recomputed from pieces and their hashes one by one."""
    rows = spark.createDataFrame([("a b c, d e f. g", "a b c, d e f. h\ni"), ("x", "x"), ("", "x"), ("p q. r", "s. t. u. v")], "a string, b string")
    got = [r.x for r in rows.select(F.expr(fingerprints.like_part("a")).alias("la"), F.expr(fingerprints.like_part("b")).alias("lb")).select(fingerprints.likeness("la", "lb").alias("x")).collect()]
    pieces = lambda t: re.findall(r"(?:[^\s.,;:!?|]+[ \t]*){1,8}[.,;:!?|]*", t)
    known = sorted({p for r in rows.collect() for t in r for p in pieces(t)})
    hashed = spark.createDataFrame([(p,) for p in known], "p string").select("p", *[F.expr(f"xxhash64(p, {2000 + s})").alias(f"h{s}") for s in range(fingerprints.SEEDS)]).collect()
    bits = {r.p: [1 if r[f"h{s}"] >> (20 * j + k) & 1 else -1 for s in range(fingerprints.SEEDS) for k in range(20) for j in range(3)] for r in hashed}
    vector = lambda t: [sum(x) for x in zip(*[bits[p] for p in pieces(t)], strict=True)]
    for r, x in zip(rows.collect(), got, strict=True):
        if r.a == r.b or not r.a:
            assert x == (1.0 if r.a == r.b else 0.0)
            continue
        a, b = vector(r.a), vector(r.b)
        cosine = sum(p * q for p, q in zip(a, b, strict=True)) / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5
        assert abs(x - max(0.0, cosine)) < 1e-9


def test_fingerprint_counters_hold_long_texts(spark):
    """1,100,000 equal pieces pass 2**20, and 2,200,000 different ones pass it in every counter."""
    rows = spark.range(1).select(F.expr("repeat('a,', 1100000)").alias("t"), F.expr("array_join(transform(sequence(1, 2200000), i -> concat('w', i, ',')), '')").alias("u"))
    got = rows.select(F.expr(fingerprints.like_part("t")).alias("t"), F.expr(fingerprints.like_part("u")).alias("u")).select(F.expr(fingerprints.signed("t")).alias("t"), F.expr(fingerprints.signed("u")).alias("u")).first()
    assert {abs(x) for x in got.t} == {1_100_000.0}
    assert max(map(abs, got.u)) < 6 * 2_200_000**0.5


def test_preferences(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good é"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", "x"),
        (2, True, 0, "user", "a"), (3, False, 0, None, None), (4, True, 0, "user", "q"), (4, False, 0, "user", "q"), (None, True, 0, "user", "q"), (5, None, 0, "user", "q"),
        (6, True, None, "system", "s"), (6, True, 1, "assistant", "z"), (6, True, 1, "assistant", "y"), (6, False, 0, "system", "s"),
    ]
    turns = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string")
    got = {r.pair_id: tuple(r)[1:] for r in chat_format.preference_pairs(turns).collect()}
    line = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[1] == (1, line("user", "hi"), line("assistant", "good é"), line("assistant", "bad") + line("user", "x"), "14:27", "14:24")
    assert got[2] == (0, "", line("user", "a"), "", "", "") and got[3] == (0, "", "", line("", ""), "", "")
    assert got[4] == (1, line("user", "q"), "", "", "", "") and set(got) == {1, 2, 3, 4, 6}
    assert got[6] == (1, line("system", "s"), line("assistant", "y") + line("assistant", "z"), "", "14:22,37:45", "")
    for r in chat_format.preference_pairs(turns).collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[int(s) : int(e)].endswith("<|end|>") for s, e in (x.split(":") for x in mask.split(",") if x))
    assert chat_format.preference_pairs(turns.limit(0)).count() == 0


def test_forked_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "yo"), (1, 1, "assistant", "one"), (1, 2, "user", "and"), (1, 3, "assistant", "two"), (1, 4, "user", "bye"),
        (2, 0, "assistant", "alone"), (4, 0, "user", "q"), (5, 0, "assistant", "z"), (None, 0, "assistant", "n"), (6, 0, "assistant", "same"), (7, None, None, None), (7, 1, "assistant", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash")).withColumn("chosen", F.lit(1))
    got = {r.pair_id: tuple(r)[1:5] for r in chat_format.forked_pairs(turns).collect()}
    line = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[0] == (1, line("user", "hi"), line("assistant", "good"), line("assistant", "two"))
    assert got[1] == (3, line("user", "yo") + line("assistant", "one") + line("user", "and"), line("assistant", "two") + line("user", "bye"), line("assistant", "good"))
    assert got[2] == (0, "", line("assistant", "alone"), "") and got[4][0] == got[5][0] == 0 and got[4][3] == ""
    assert got[6] == (1, line("assistant", "same"), "", "") and got[7] == (2, line("", "") + line("assistant", "same"), "", "") and len(got) == 7
    assert chat_format.forked_pairs(turns.limit(0)).count() == 0
    data = chat_format.forked_pairs(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).collect()
    assert sum(r.n_common > 0 and r.chosen_mask != "" and r.rejected_mask != "" for r in data) > 0.9 * len(data) > 0


def test_native_operators_have_no_python(spark, docs):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (chat_format.forked_pairs(turns), fingerprints.fingerprints(docs), personal_data.personal_data(docs), decontamination.contamination(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6, "1234 !!", "en", "s", 7), (10**6 + 1, None, None, None, None)], docs.schema)
    rows = docs.unionByName(more)
    lang = p.identify(spark, rows, SF)
    assert lang.count() == docs.count() and lang.columns == docs.columns
    kept = p.deduplicate(spark, docs, SF)
    want = brute.near_duplicates({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in want.items() if k == c} and kept.columns == docs.columns
    clean = p.decontaminate(spark, docs, SF)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hits = brute.contamination({r.doc_id: r.text for r in docs.collect()}, items)
    assert {r.doc_id for r in clean.collect()} == {k for k, v in hits.items() if not v[4]} and clean.columns == docs.columns
    red = p.redact(spark, docs, SF)
    assert red.columns == docs.columns and all(not brute.personal(r.text) for r in red.collect())
    ids = p.tokenize(spark, docs.limit(20), SF)
    assert isinstance(ids.schema["ids"].dataType, ArrayType) and ids.count() == 20
    assert p.run(spark, SF).count() <= kept.count() and [n for n, _ in p.STAGES][0] == "language_id"


def test_pipeline_stages_on_odd_tables(spark, empty):
    """Empty tables, nulls, repeated rows, and other columns with the names that stages use themselves."""
    import corpus_pipeline as p

    names = ["version", "bad_id", "bad_text", "x", "c0", "fit", "n", "h", "rep", "component_id", "row", "_row", "spans", "base", "cand", "found", "w", "lead", "email", "k", "doc"]
    base = spark.createDataFrame([(1, "the house is in the town", "en", "s", 4), (1, "the house is in the town", "en", "s", 4), (2, None, None, None, None), (3, "", "en", None, 0), (None, "the cat and the dog", None, "s", 3), (4, "a the " * 4000, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.select("*", *[F.lit(c).alias(c) for c in names], F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    for name, stage in p.STAGES:
        none = stage(spark, docs.limit(0), SF)
        some = stage(spark, docs, SF)
        assert none.count() == 0 and none.columns == some.columns
        kept = [c for c in docs.columns if c != "text"] + ["n_tokens", "ids"] if name == "byte_bpe" else docs.columns
        assert some.columns == kept, name
        got = sorted((r.doc_id or 0, r.version, r.m["a"]) for r in some.collect())
        want = {"language_id": [0, 1, 1, 4], "near_dedup": [0, 1, 2, 3, 4]}.get(name, [0, 1, 1, 2, 3, 4])
        assert got == [(i, "version", 1) for i in want], name


def test_counts_and_languages_of_odd_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, None), (7, "x"), (7, "x")], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("n_tokens", F.lit("clash"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0) for r in token_counts.token_counts(rows, path).collect()) == [(0, 0, False), (0, 3, True), (7, 1, True), (7, 1, True)]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in language_id.identify_languages(rows).collect()) == [(0, "en"), (0, "und"), (7, "en"), (7, "en")]


def test_languages_match_brute_force(spark):
    """Every prediction and score of the table, recomputed from dictionaries of n-grams and ranks."""
    import collections
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()

    def grams(text):
        out = collections.Counter()
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        for n in (1, 2, 3):
            out.update(clean[i : i + n] for i in range(len(clean) - n + 1) if clean[i : i + n] != " ")
        return out

    ranked = lambda found: {g: i for i, (g, _) in enumerate(sorted(found.items(), key=lambda x: (-x[1], [len(x[0]), *map(ord, x[0])]))[: language_id.PROFILE])}
    totals = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            totals[r.lang].update(grams(r.text))
    profiles = {lang: ranked(found) for lang, found in totals.items()}
    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    size = language_id.PROFILE
    for r in rows:
        own = ranked(grams(r.text or ""))
        if not own:
            assert got[r.doc_id].lang_pred == "und"
            continue
        far = sorted((sum(min(abs(i - p[g]), size) if g in p else size for g, i in own.items()), lang) for lang, p in profiles.items())
        assert got[r.doc_id].lang_pred == far[0][1] and abs(got[r.doc_id].score - far[1][0] / (far[0][0] + far[1][0])) < 1e-12
