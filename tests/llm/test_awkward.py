"""Awkward tables for every operator and stage: null and repeated ids, repeated rows, null, empty and very long texts, extra columns with the operators' own
names, empty tables; and words that an algebraic hash would confuse."""

import collections
import math

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlake.llm import ann_tree, decontam, hmm, language_id, minhash, packing, quality, queries, suffix_dedup, textscan, url_filter, warc

PASSAGE = " ".join(f"shared{i} passage{i * 7 % 13}" for i in range(40))
#: Names that the operators use for themselves.
CLASHING = ("row", "key", "whole", "listed", "_id", "kept", "spans", "n_bytes", "lang_pred", "score", "best", "t", "c0", "d_text", "block", "label", "turn", "rep", "component", "bin", "span", "n", "_salt")


def texts():
    rng = np.random.default_rng(23)
    say = lambda n: " ".join(rng.choice([f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "rs", "ll")], n))
    base = say(300)
    long = say(260_000)  # over twice a chunk
    return [
        (1, base), (1, base), (1, say(50)), (None, base), (None, say(60)), (None, None), (2, None), (3, ""), (4, " \t\n "), (5, PASSAGE + " " + say(40)), (6, say(40) + " " + PASSAGE), (7, long), (8, say(30) + " " + long[: len(long) // 2]),
        (9, "x"), (10, "日本語 текст ß"), (11, base.replace("a", "o", 3)), (11, base.replace("a", "o", 3)), (12, "1 2 3 !"),
    ]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("de", "en")[n % 2] if n % 3 else None) for n, (i, t) in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(c) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_repeats(docs, none, rows):
    raw, gone = brute.repeated_bytes([t for _, t, _ in rows])
    got = suffix_dedup.remove_repeats(docs, carry=["doc_id", *CLASHING])
    want = sorted(((i, np.frombuffer(b, np.uint8)[~g].tobytes(), len(b)) for (i, _, _), b, g in zip(rows, raw, gone)), key=repr)
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"]) for r in got.collect()), key=repr) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_near_duplicates(docs, none, rows):
    group, sizes = brute.near_groups([t for _, t, _ in rows], 4)
    least = {}
    for g, (i, _, _) in zip(group, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, n, least.get(g), i is not None and least.get(g) == i) for g, n, (i, _, _) in zip(group, sizes, rows)), key=repr)
    assert pairs(minhash.near_duplicates(docs, minhash.SketchParams(k=4)), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(none).count() == 0


def test_leaks(spark, docs, none, rows):
    tests = [(1, PASSAGE), (2, PASSAGE), (3, None), (None, PASSAGE), (4, ""), (5, "x"), (5, "x"), (6, " ".join(rows[0][1].split()[:30]))]
    t = spark.createDataFrame(tests, "item_id long, text string").withColumn("row", F.lit(0))
    hit = brute.leaks([x for _, x, _ in rows], [x for _, x in tests], decontam.SeedParams())
    want = {(rows[i][0], tests[j][0]) for i, j in hit if tests[j][0] is not None}
    assert set(pairs(decontam.find_leaks(docs, t), "doc_id", "item_id")) == want and len(want) > 5
    left = decontam.remove_leaks(docs, t)
    assert left.columns == docs.columns
    leaking = {i for i, j in hit if tests[j][0] is not None}
    assert pairs(left, "doc_id", "text") == sorted(((i, x) for n, (i, x, _) in enumerate(rows) if n not in leaking), key=repr)
    assert decontam.find_leaks(none, t).count() == 0 and decontam.remove_leaks(docs, t.where("false")).count() == len(rows) and decontam.find_leaks(docs, t.where("false")).count() == 0


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    got = collections.Counter()
    for r in packing.pack(docs, queries.vocabulary_path()).collect():
        got[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for i, t, _ in rows:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want and packing.pack(none, queries.vocabulary_path()).count() == 0


def test_second_pass_keeps_to_its_bins(spark):
    p = packing.PackParams(capacity=64, open_bins=32, block=128, second_part=200)
    words = spark.createDataFrame([(i, "a " * (i * 7 % 50)) for i in range(600)], "doc_id long, text string").repartition(7)
    got = packing.pack(words, queries.vocabulary_path(), p).toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 64 and len(got) == 600 and len(fill) <= 1.2 * fill.sum() / 64
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]


def naive_bayes(train, text, p):
    """The same model with plain counters."""
    def grams(t):
        t = (t or "").lower()
        for n in p.orders:
            for i in range(len(t) - n + 1):
                h = 0
                for ch in t[i : i + n]:
                    h = (h * 40503 + ord(ch)) & 0xFFFFFFFF
                g = (h * 2654435761) & 0xFFFFFFFF
                g ^= g >> 15
                g = ((g + n * 7919) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF
                yield (g >> 16) % p.buckets
    counts = collections.defaultdict(collections.Counter)
    for t, lang in train:
        if t is not None and lang is not None:
            counts[lang].update(grams(t))
    own = collections.Counter(grams(text))
    total = {}
    for lang in sorted(counts):
        mass = sum(counts[lang].values()) + p.smoothing * p.buckets
        total[lang] = p.weight * sum(n * math.log((counts[lang][g] + p.smoothing) / mass) for g, n in own.items())
    top = max(total.values())
    return max(total, key=lambda x: total[x]), 1 / sum(math.exp(v - top) for v in total.values())


@pytest.mark.parametrize("at_once", [256, 1])
def test_language(docs, none, rows, at_once):
    p = language_id.LanguageParams(at_once=at_once)
    few = docs.where("length(text) < 5000 or text is null")
    langs, matrix = language_id.train(few, p)
    got = pairs(language_id.predict(few, langs, matrix, p, carry=["doc_id", "text", *CLASHING]), "doc_id", "text", "lang_pred", "score")
    short = [(i, t, x) for i, t, x in rows if t is None or len(t) < 5000]
    assert len(got) == len(short) and langs == ["de", "en"]
    for _, t, lang, score in got:
        if not any(c.isalpha() for c in t or ""):
            assert (lang, score) == ("und", 0.0)
        else:
            want, sure = naive_bayes([(t, x) for _, t, x in short], t, p)
            assert lang == want and score == pytest.approx(sure, rel=1e-3)
    assert {r[0] for r in pairs(language_id.predict(docs, *language_id.train(none)), "lang_pred")} == {"und"}
    assert language_id.predict(none, langs, matrix, p).count() == 0 and language_id.predict(docs, langs, matrix, p).count() == len(rows)


def test_quality(spark, docs, none, rows):
    """Weights against a loop over dictionaries."""
    p = quality.QualityParams(buckets=1 << 12, epochs=2)
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (6, 0), (11, None), (10, 0), (99, 1), (None, 1)], "doc_id long, label int").withColumn("text", F.lit("?"))
    known = {1: 0, 5: 1, 6: 0, 10: 0}
    got = quality.train(docs.where("length(text) < 5000"), labels, p)
    turn = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    sample = sorted(((turn[i], known[i], t) for i, t, _ in rows if i in known and t and len(t) < 5000), key=lambda x: x[0])
    ones = [x for x in sample if x[0] == turn[1]]
    assert len(ones) == 3  # all rows of a repeated id are learned from; their order within the id is that of the table
    if len({t for _, _, t in sample}) == len(sample):
        for _ in range(p.epochs):
            for _, y, t in sample:
                data, offsets = textscan.text_bytes(pa.array([t]))
                at, x = next(iter(quality.features(data, offsets, p)))
                x = x.astype(np.float32).astype(float)
                w = [weight(i) for i in at.tolist()]
                g = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - y
                for i, v, old in zip(at.tolist(), x, w):
                    z[i] += g * v - (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / p.alpha * old
                    n[i] += (g * v) ** 2
        assert got == pytest.approx([weight(i) for i in range(p.buckets)], abs=1e-9)
    scored = pairs(quality.score(docs, got, p), "doc_id", "score", "predicted")
    assert len(scored) == len(rows) and all(0 <= s <= 1 and k == int(s >= p.threshold) for _, s, k in scored)
    assert quality.score(none, got, p).count() == 0 and not quality.train(none, labels, p).any()


def test_ftrl_against_a_loop():
    p = quality.QualityParams(buckets=8)
    rng = np.random.default_rng(4)
    model, z, n = quality.Ftrl(p), np.zeros(8), np.zeros(8)
    for _ in range(60):
        at = rng.choice(8, 3, replace=False)
        x, y = rng.random(3), int(rng.integers(0, 2))
        w = [0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2) for i in at]
        g = [(1 / (1 + math.exp(-float(np.dot(w, x)))) - y) * v for v in x]
        for i, gi, wi in zip(at, g, w):
            z[i] += gi - (math.sqrt(n[i] + gi * gi) - math.sqrt(n[i])) / p.alpha * wi
            n[i] += gi * gi
        model.learn(at, x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_hmm(docs, none, rows):
    p = hmm.HmmParams(states=2, top_words=20, tail_classes=16, first_rounds=1, full_rounds=1, least_gain=1.0, block_bytes=20_000)
    got = pairs(hmm.score_texts(docs, F.col("doc_id") != 2, p), "doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    counts = collections.Counter(w for i, t, _ in rows if i not in (None, 2) for w in [*brute.words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        w = [*brute.words(t), None]
        want.append((i, i not in (None, 2), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    assert hmm.score_texts(none, F.lit(True), p).count() == 0
    assert all(r[4] == 0 and math.isfinite(r[6]) for r in pairs(hmm.score_texts(docs.where("length(text) < 5000"), F.lit(False), p), "doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def test_baum_welch_against_all_paths():
    """Expected counts and likelihood of short segments, by the sum over all state paths."""
    rng = np.random.default_rng(9)
    p = hmm.HmmParams(states=2, top_words=2, tail_classes=2, segment=4, scaling=3)
    emit = rng.random((p.classes, 2)) + 0.1
    m = hmm.Model(np.array([0.3, 0.7]), np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), emit / emit.sum(0))
    cls, ptr = rng.integers(0, p.classes, 13), np.array([0, 6, 7, 13])
    start, again, move, seen, fit = np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((p.classes, 2)), 0.0
    for a, b in zip(ptr[:-1], ptr[1:]):
        for lo in range(a, b, p.segment):
            own = cls[lo : min(lo + p.segment, b)]
            first = m.start if lo == a else m.again
            mass, parts = 0.0, []
            for path in np.ndindex(*[2] * len(own)):
                x = first[path[0]] * m.emit[own[0], path[0]]
                for t in range(1, len(own)):
                    x *= m.move[path[t - 1], path[t]] * m.emit[own[t], path[t]]
                mass += x
                parts.append((path, x))
            fit += math.log10(mass)
            for path, x in parts:
                (start if lo == a else again)[path[0]] += x / mass
                for t, s in enumerate(path):
                    seen[own[t], s] += x / mass
                    if t:
                        move[path[t - 1], s] += x / mass
    got = hmm.expected_counts(cls, ptr, m, p)
    for x, y in zip(got, (start, again, move, seen, [fit, 13])):
        assert np.allclose(x, y)


def test_neighbours_of_repeated_rows_by_few_leaves(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 12)) * 4
    x = np.concatenate([c + rng.normal(size=(40, 12)) * 0.3 for c in centres]) * rng.uniform(0.5, 2, (2400, 1))
    base = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, leaf int")
    v = ann_tree.usable(base.union(base).union(base).withColumn("cell", F.lit(1)))
    p = ann_tree.TreeParams(leaf_rows=32, part_rows=300, query_part=50, recall=0.95)
    seen = []
    calibrated = ann_tree._calibrated
    ann_tree._calibrated = lambda indexed, shared, q: seen.append((calibrated(indexed, shared, q), shared.value.n_leaves)) or seen[-1][0]
    try:
        got = ann_tree.search(v, v.where("vec_id % 20 = 0"), p).toPandas()
    finally:
        ann_tree._calibrated = calibrated
    visited, leaves = seen[0]
    assert leaves >= 50 and visited < leaves / 3
    hits = 0
    for q in range(0, 2400, 20):
        own = got[got.query_id == q].sort_values("rank")
        s = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(2400), -s)) if i != q][:20]
        assert len(own) == 20 and own.vec_id.is_unique and q not in set(own.vec_id)
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 20 * 120
    few = ann_tree.usable(base.where("vec_id < 5"))
    assert ann_tree.search(few, few.where("vec_id = 0")).count() == 4


def test_urls(spark):
    urls = ["http://a.com/" + "x" * 2_000_000, "http://a.com/en/", None, None, "http://b.net/es/", "http://b.net/es/", "://", "http://", ""]
    pages = spark.createDataFrame([(n // 2, u, "h", 1, 2.0) for n, u in enumerate(urls)] + [(None, "http://c.org/", "h", 1, 2.0)], "page_id long, url string, host string, rows int, rate double")
    outcomes = spark.createDataFrame([("http://a.com/1", 1), ("http://a.com/1", 1), (None, 0), ("http://b.net/", None)], "url string, good int").withColumn("host", F.lit("z"))
    got = pairs(url_filter.judge_urls(pages, outcomes, queries.RULES), "page_id", "host", "rule", "verdict")
    assert len(got) == 10 and got.count((2, "b.net", "net/es/", "block")) == 2 and sum(h == "" for _, h, _, _ in got) == 5
    many = [url_filter.Rule("block", f"x{i}.com/") for i in range(300)] + queries.RULES
    assert pairs(url_filter.judge_urls(pages, outcomes, many), "page_id", "host", "rule", "verdict") == got
    assert url_filter.judge_urls(pages.where("false"), outcomes, queries.RULES).count() == 0


def test_revisits(spark):
    row = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, slot string, got string"
    h = {"etag": "v"}
    rows = [(1, None, 1, "response", "v", None, None, h, "", ""), (2, None, 5, "revisit", "v", None, None, h, "", ""), (3, "a", 1, "response", "v", None, None, h, "", ""), (3, "a", 1, "response", "v", None, None, h, "", "")]
    rows += [(4, "a", 9, "revisit", "v", None, None, None, "", "")] * 2 + [(None, "a", 9, "revisit", "w", None, None, None, "", ""), (5, "a", None, "revisit", "v", None, None, None, "", ""), (6, "a", None, "response", "v", None, None, None, "", "")]
    rows += [(7, "http://" + "long" * 500_000, 1, "response", "v", None, None, h, "", ""), (8, "http://" + "long" * 500_000, 2, "revisit", "v", None, None, h, "", ""), (9, "b", 2, None, "v", None, None, h, "", "")]
    got = pairs(warc.resolve_revisits(spark.createDataFrame(rows, row)), "record_id", "target_id", "status")
    assert got == sorted([(2, None, "missing"), (4, 3, "resolved"), (4, 3, "resolved"), (None, 3, "changed"), (5, None, "missing"), (8, 7, "resolved")], key=repr)


def mates(n):
    a, b = b"a", b"b"
    while len(a) < n:
        a, b = a + b, b + a
    return a.decode(), b.decode()


def test_words_that_a_polynomial_hash_confuses(spark):
    """The Thue-Morse word and its complement are equal modulo 2**64 under every odd base."""
    a, b = mates(1024)
    filler = " ".join(f"word{i}" for i in range(30))
    d = spark.createDataFrame([(0, f"{a} {filler}"), (1, f"{b} {filler}"), (2, f"{a} {b}")], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([(0, f"{a} x y z"), (1, f"{b} x y z")], "doc_id long, text string"), minhash.SketchParams(k=4)).collect()} == {0, 1}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    import zlib

    for r in packing.pack(d, queries.vocabulary_path()).where("piece = 0 and length < 4096").collect():
        t = [f"{a} {filler}", f"{b} {filler}", f"{a} {b}"][r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes())
    known = {r["doc_id"]: r["n_known"] for r in hmm.score_texts(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), F.col("doc_id") == 0, hmm.HmmParams(states=2, top_words=1, tail_classes=4, first_rounds=1, full_rounds=1)).collect()}
    assert known == {0: 2, 1: 1}
    tests = spark.createDataFrame([(7, b)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.find_leaks(d.where("doc_id < 2"), tests).collect()] == [1]
    data, offsets = textscan.text_bytes(pa.array([a, b]))
    x, y = (at.tolist() for at, _ in quality.features(data, offsets, quality.QualityParams()))
    assert x != y
    rng = np.random.default_rng(0)
    size = rng.integers(1, 40, 1_000_000)
    end = np.cumsum(size)
    raw = rng.integers(97, 101, end[-1]).astype(np.uint8)
    different = len({raw[s:e].tobytes() for s, e in zip((end - size).tolist(), end.tolist())})
    assert len(np.unique(textscan.range_hash(raw, end - size, end))) == different


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(textscan, "range_hash", lambda data, s, e, lane=0: (e - s).astype(np.uint64))
    data, offsets = textscan.text_bytes(pa.array(["one two six one"]))
    starts, ends, _ = textscan.words(data, offsets)
    first, number = textscan.factorize(data, starts, ends)
    assert first.tolist() == [0, 1, 2] and number.tolist() == [0, 1, 2, 0]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, rows, stage):
    sf = "/root/testdata/sf0.001"
    got = stage(spark, docs, sf)
    assert stage(spark, none, sf).count() == 0
    if stage is corpus_pipeline.pack_sequences:
        assert sorted({r["doc_id"] for r in got.collect()}, key=repr) == sorted({i for i, _, _ in rows}, key=repr)
        return
    assert got.columns == docs.columns and {tuple(r) for r in got.select(*CLASHING).collect()} <= {CLASHING}
    kept = collections.Counter(pairs(got, "doc_id", "text"))
    given = collections.Counter((i, t) for i, t, _ in rows)
    if stage is corpus_pipeline.keep_known_languages:
        assert kept <= given and all(any(c.isalpha() for c in t or "") for _, t in kept)
    elif stage is corpus_pipeline.keep_one_of_near_copies:
        group, _ = brute.near_groups([t for _, t, _ in rows], 5)
        best = {}
        for n, (g, (i, t, _)) in enumerate(zip(group, rows)):
            best[g] = min(best.get(g, ((True, math.inf), n)), ((i is None, i if i is not None else math.inf), n))
        assert collections.Counter(i for i, _ in kept.elements()) == collections.Counter(rows[n][0] for _, n in best.values())
    elif stage is corpus_pipeline.drop_benchmark_leaks:
        assert kept <= given and kept[None, None] == 1 and kept[3, ""] == 1
    else:
        raw, gone = brute.repeated_bytes([t for _, t, _ in rows])
        left = [(i, t if t is None else np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore"), g.any()) for (i, t, _), b, g in zip(rows, raw, gone)]
        assert kept == collections.Counter((i, t) for i, t, cut in left if not cut or t.strip(" "))
