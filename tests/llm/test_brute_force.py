"""The operators against plain Python on small fixtures, with the awkward cases: nulls, empty and long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import collections

import math
import re
import zlib

import numpy as np
import pytest

from emberlake.llm import ann_tree, components, decontam, hmm, language_id, minhash, packing, quality, queries, runtime, suffix_dedup, url_filter, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i} passage{i * 7 % 13}" for i in range(40))


def texts():
    rng = np.random.default_rng(17)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base = say(400)
    near = base.split()
    near[100] = "changed"
    far = [w if i % 9 else f"x{i}" for i, w in enumerate(base.split())]
    out = [base, base, " ".join(near), " ".join(far), None, "", "   \n", "one two", "Ein ΣTEXT’s 日本 'tis 12.5!!", say(30) + " " + PASSAGE + say(30), PASSAGE + " " + say(50), "ab" * 4000, "a" * 700, say(9000)]
    out += [say(int(n)) for n in rng.integers(1, 120, 25)]
    out += [PASSAGE.upper(), "DON'T <|endoftext|> x", "\u0000 null byte", "İstanbul ÀÖ×÷ÿ"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("de", "en")[i % 2] if i % 5 else None, i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def test_repeats(spark, docs, none):
    raw = {i: (t or "").encode() for i, t in enumerate(texts())}
    seen = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for p in (suffix_dedup.RepeatParams(), suffix_dedup.RepeatParams(most=1, widths=(7, 1), block=500), suffix_dedup.RepeatParams(least_hot=0, most=1)):
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, p).collect()}
        assert len(got) == len(raw)
        for d, b in raw.items():
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 199):
                if seen[b[i : i + 200]] > 1:
                    gone[i : i + 200] = True
            assert bytes(got[d]["kept"]) == np.frombuffer(b, np.uint8)[~gone].tobytes(), d
            assert sum(s["stop"] - s["begin"] for s in got[d]["spans"]) == gone.sum()
            assert len(got[d]["spans"]) == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize(("k", "block"), [(4, 2048), (4, 3)])
def test_near_duplicates(docs, none, k, block):
    sets = {}
    for d, t in enumerate(texts()):
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}
    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {d: new if c == old else c for d, c in up.items()}
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, minhash.SketchParams(k=k, block=block)).collect()}
    assert {d: (r["component_id"], r["n_shingles"], r["kept"]) for d, r in got.items()} == {d: (up[d], len(s), up[d] == d) for d, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [5])
def test_bridged_families_become_one_component(spark, block):
    """A chain of texts of which only neighbours are near, read in an order that hides the chain."""
    words = [f"w{i}" for i in range(600)]
    rows = [(int(i * 37 % 101), " ".join(words[i * 4 : i * 4 + 200])) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.SketchParams(k=4, block=block))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(2)
    p = minhash.SketchParams()
    common = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.sort(np.concatenate([common, rng.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in "ab")
    r = minhash.registers([a, b, np.sort(np.concatenate([a, b]))], p)
    assert (np.maximum(r[0], r[1]) == r[2]).all()  # mergeable
    e = minhash.estimate(r[:1], r[1:2], np.array([900.0]), np.array([900.0]), p.base)
    assert abs(e[0] - 0.8) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(5, 9), (9, 5), (5, 5)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components.components(edges, runtime.Scratch(spark)).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 5: 5, 9: 5}


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).toPandas()
    total = 0
    for d, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want = [(i, s, min(4096, len(ids) - s), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
        own = got[got.doc_id == d].sort_values("piece")
        assert list(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want, d
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(total / 4096) + 1
    assert packing.pack(none, path).count() == 0


def test_leaks(spark, docs, none):
    w = PASSAGE.split()
    swapped = " ".join("swap" if i % 11 == 5 else x for i, x in enumerate(w))
    tests = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, swapped), (4, None), (5, "not there"), (7, ""), (6, "nothing like it " * 9)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, tests).collect()}
    holders = [d for d, t in enumerate(texts()) if t and PASSAGE.lower() in t.lower()]
    assert len(holders) == 3 and got == {(d, i) for d in holders for i in (1, 2, 3)}
    assert decontam.remove_leaks(docs, tests).count() == docs.count() - 3
    assert decontam.find_leaks(none, tests).count() == 0 and decontam.find_leaks(docs, tests.where("false")).count() == 0


def test_hmm_base_scores_and_forward(docs, none):
    p = hmm.HmmParams(states=3, top_words=50, tail_classes=20, first_rounds=2, full_rounds=1, block_bytes=500, together=100, segment=7, scaling=3)
    got = {r["doc_id"]: r for r in hmm.score_texts(docs, runtime.fold("doc_id", 5) != 1, p).collect()}
    counts, tokens = collections.Counter(), {}
    for d, t in enumerate(texts()):
        tokens[d] = [*WORD.findall(lower(t)), None]
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, w in tokens.items():
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[d]["base_score"] == pytest.approx(base, abs=1e-6) and got[d]["score"] < 0
    assert hmm.score_texts(none, runtime.fold("doc_id", 5) != 1, p).count() == 0
    rng = np.random.default_rng(1)
    emit = rng.random((5, 2))
    m = hmm.Model(np.array([0.3, 0.7]), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.4, 0.6]]), emit / emit.sum(0))
    cls = np.array([0, 3, 1, 4, 2])
    total = 0.0
    for path in np.ndindex(2, 2, 2, 2, 2):
        x = m.start[path[0]] * m.emit[cls[0], path[0]]
        for t in range(1, 5):
            x *= m.move[path[t - 1], path[t]] * m.emit[cls[t], path[t]]
        total += x
    assert hmm.forward(cls, np.array([0, 5]), m)[0] == pytest.approx(math.log10(total))


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1.0])]
    v = ann_tree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert v.count() == 600
    got = ann_tree.search(v, v.where("vec_id % 20 = 0"), ann_tree.TreeParams(leaf_rows=32, part_rows=50)).toPandas()
    hits = 0
    d = x.astype(float)
    for q in range(0, 600, 20):
        s = (d * d[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        hits += len(set(best) & set(own.vec_id))
        assert all(abs(a - s[i]) < 1e-12 for a, i in zip(own.score, own.vec_id))
    assert hits >= 0.9 * 20 * 30
    assert ann_tree.search(v.where("false"), v.where("false")).count() == 0


def test_language_and_quality(spark, docs, none):
    langs, matrix = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, langs, matrix).collect()}
    assert len(got) == len(texts()) and got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.predict(docs, *empty).collect()} == {"und"}
    good = " ".join(f"calm{i % 17} words{i % 5}" for i in range(60))
    bad = "BUY!!! NOW!!! " * 30
    d = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(200)] + [(500, None), (501, "")], "doc_id long, text string")
    l = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, None), (999, 1)], "doc_id long, label int")
    s = {r["doc_id"]: r for r in quality.score(d, quality.train(d, l)).collect()}
    assert len(s) == 202 and s[199]["predicted"] == 1 and s[198]["predicted"] == 0 and 0 <= s[500]["score"] <= 1
    assert {r["score"] for r in quality.score(d, quality.train(d, l.where("false"))).collect()} == {0.5}


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/1", "http://x.net/es/", "http://x.net", "no scheme", None, "ftp://notexample.com/en/", "http://bad.org/1", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(f"http://bad.org/{i}", 0) for i in range(200)] + [(f"http://x.net/{i}", 1) for i in range(200)] + [(None, 1), ("http://y.net/", None)], "url string, good int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, outcomes, queries.RULES).collect()}
    assert [got[i]["host"] for i in range(9)] == ["a.example.com", "www.example.com", "x.net", "x.net", "", "", "notexample.com", "bad.org", ""]
    assert [got[i]["rule"] for i in range(9)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, "com/", None, None]
    assert (got[0]["path"], got[3]["path"], got[3]["verdict"], got[7]["verdict"]) == ("/en/x", "", "allow", "block")
    table = spark.createDataFrame([(r.text, r.verdict) for r in queries.RULES], "text string, verdict string")
    by_join = {(r["host"], r["path"]): r["rule"] for r in url_filter.rule_table(spark.createDataFrame([(r["host"], r["path"]) for r in got.values()], "host string, path string"), table).collect()}
    assert all(by_join.get((r["host"], r["path"])) == r["rule"] for r in got.values())
    assert url_filter.judge_urls(pages.where("false"), outcomes.where("false"), []).count() == 0


def test_revisits(spark):
    h = {"etag": "v1", "content-type": "text/html", "age": "0"}
    light = {"etag": "v1", "content-type": "none", "age": "9"}
    rows = [
        (1, "http://www.a.com/p/?b=2&a=1&utm_x=1#f", 10, "response", '"v1"', None, "d1", h), (2, "https://a.com/p?a=1&b=2", 20, "response", '"v2"', None, "d2", h), (3, "https://a.com/p?a=1&b=2", 20, "response", '"v3"', None, "d3", h),
        (4, "a.com/p?a=1&b=2", 15, "revisit", 'W/"v1"', None, None, light), (5, "a.com/p?a=1&b=2", 21, "revisit", '"v2"', None, None, light), (6, "a.com/p?a=1&b=2", 10, "revisit", '"v1"', None, None, light),
        (7, "a.com/p?a=1&b=2", 99, "revisit", None, None, "d3", None), (8, "a.com/p?a=1&b=2", 99, "revisit", None, None, None, None), (9, None, 99, "revisit", "v1", None, None, None), (10, "b.com", None, "revisit", "v1", None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    for bucket in (1, 7, 1000):
        got = {r["record_id"]: (r["target_id"], r["status"]) for r in warc.resolve_revisits(df, bucket).collect()}
        assert got == {4: (1, "resolved"), 5: (3, "changed"), 6: (None, "missing"), 7: (3, "resolved"), 8: (3, "unvalidated"), 9: (None, "missing"), 10: (None, "missing")}
    merged = {r["record_id"]: r["headers"] for r in warc.resolve_revisits(df).collect()}
    assert merged[4] == {"etag": "v1", "content-type": "text/html", "age": "9"} and merged[5] is None
    assert warc.resolve_revisits(df.where("false")).count() == 0
