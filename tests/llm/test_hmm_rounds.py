"""Baum-Welch takes every training text in every round and goes on until it gains little."""

import numpy as np

from emberlake.llm import hmm, runtime


def test_rounds_take_all_texts_until_converged(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(30)] for k in ("ba", "do", "ki")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 20))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, fits = [], []
    step = hmm._round

    def watched(docs, *rest):
        seen.append(docs.count())
        got = step(docs, *rest)
        fits.append(got[1])
        return got

    monkeypatch.setattr(hmm, "_round", watched)
    p = hmm.HmmParams(states=3, top_words=50, tail_classes=20, first_rounds=2, full_rounds=1)
    assert hmm.score_texts(docs, runtime.fold("doc_id", 5) != 1, p).count() == 3000
    training = docs.where(runtime.fold("doc_id", 5) != 1).count()
    assert len(seen) >= 3 and set(seen) == {training}
    assert fits[-1] - fits[-2] < p.least_gain and all(b > a - 1e-3 for a, b in zip(fits, fits[1:]))
    assert all(b - a >= p.least_gain for a, b in zip(fits[2:-2], fits[3:-1]))
