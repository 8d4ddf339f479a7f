"""Leaks against a scan of all diagonals, from a similarity of 0.8 on."""

from itertools import combinations

import numpy as np
import pytest

from emberlake.llm import decontam


def met(mask, equal):
    return any(all(equal[i + j] for j, c in enumerate(mask) if c == "1") for i in range(len(equal) - len(mask) + 1))


def test_masks_meet_every_pattern():
    p = decontam.SeedParams()
    for n in range(1, 22):
        masks = p.masks if n >= 13 else decontam.whole_masks(n, p.similarity)
        wrong = max(k for k in range(n) if n - k >= p.similarity * n)
        for gone in combinations(range(n), wrong):
            assert any(met(m, [i not in gone for i in range(n)]) for m in masks), (n, gone)


def test_every_fifth_word_replaced(spark):
    rows = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in (15, 16, 20, 100, 1000)]
    docs = [(n, "before it " + " ".join(w if i % 5 != 2 else f"new{i}" for i, w in enumerate(t.split())) + " after it") for n, t in rows]
    docs, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, tests).collect()} == {(n, n) for n, _ in rows}
    assert decontam.remove_leaks(docs, tests).count() == 0


def brute(doc, test, p):
    """Whether some stretch of some diagonal counts: the best-scoring one, or the whole overlap."""
    for start in range(-len(test) + 1, len(doc)):
        lo, hi = max(0, start), min(len(doc), start + len(test))
        equal = [doc[i] == test[i - start] for i in range(lo, hi)]
        runs = {(a, b): sum(1 if e else -p.penalty for e in equal[a:b]) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)}
        top = max(runs.values())
        for a, b in [(0, len(equal)), *(r for r, v in runs.items() if v == top)]:
            if b - a >= min(p.least_words, len(test)) and sum(equal[a:b]) >= p.similarity * (b - a):
                return True
    return False


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_same_as_all_diagonals(spark, monkeypatch, at_once):
    portions = decontam._portions
    monkeypatch.setattr(decontam, "_portions", lambda n: portions(n, at_once))
    rng = np.random.default_rng(8)
    say = lambda n: list(rng.choice([f"v{i}" for i in range(40)], n))
    tests = [say(int(n)) for n in [*range(2, 25), 40]]
    texts = []
    for t in tests:
        for share in (0.8, 0.9):
            copy = list(t)
            for i in rng.choice(len(t), int((1 - share) * len(t) + 1e-9), replace=False):
                copy[i] = "other"
            texts.append([*say(int(rng.integers(0, 6))), *copy, *say(int(rng.integers(0, 6)))])
    p = decontam.SeedParams()
    want = {(d, t) for d, words in enumerate(texts) for t, test in enumerate(tests) if brute(words, test, p)}
    assert len(want) >= len(texts)
    hits = set()
    for d, words in enumerate(texts):
        for t, test in enumerate(tests):
            number = {w: i for i, w in enumerate(dict.fromkeys([*words, *test]))}
            x, y = (np.array([number[w] for w in of]) for of in (words, test))
            if decontam.best_overlap(x, y, np.arange(-len(y) + 1, len(x)), p):
                hits.add((d, t))
    assert hits == want
    if at_once > 7:
        docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
        asked = spark.createDataFrame([(t, " ".join(w)) for t, w in enumerate(tests)], "item_id long, text string")
        assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, asked).collect()} == want
