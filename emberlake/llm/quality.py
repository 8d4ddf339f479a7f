"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features: word 1- and 2-grams of lower-cased texts, 1- and 2-grams of word shapes (kinds of the first two and last
two bytes, so unseen words are told apart too), and the pattern of repeated words (whether a word equals the one
before, or the one two before), each hashed into ``buckets``; a value is the square root of the feature's share
of the text, so every text has unit length per kind whatever its size. Training takes the ``most_labelled`` labelled
rows with the smallest id hashes (a documented bound; whole texts) in one executor task, in hash order, ``epochs``
times. Scoring is a sparse dot product per text with the broadcast weights (at most ``buckets`` numbers).
Null and empty texts have the bias as their only feature. A document labelled twice takes its smallest label.
Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 18
    most_labelled: int = 12_000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.2
    threshold: float = 0.3


_KIND = np.arange(256, dtype=np.uint64)  # signs keep their byte
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for the kinds of the first two and last two bytes of each word."""
    out = np.zeros(len(starts), np.uint64)
    for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1):
        out = out * np.uint64(256) + _KIND[data[at]]
    return out


def features(data: np.ndarray, offsets: np.ndarray, p: QualityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers (0 is the bias) and values of each row."""
    starts, ends, h, ptr = textscan.word_hashes(data, offsets)
    mask = np.uint64(p.buckets - 1)
    one = ((h >> np.uint64(7)) & mask).astype(np.int64)
    two = ((textscan.sequence_hash(h, 2) >> np.uint64(9)) & mask).astype(np.int64)
    form = textscan.mix(_shapes(data, starts, ends))
    shape = ((form >> np.uint64(11)) & mask).astype(np.int64)
    shapes = ((textscan.sequence_hash(form, 2) >> np.uint64(13)) & mask).astype(np.int64)
    near = np.zeros(len(h), np.int64)
    near[1:] += h[1:] == h[:-1]
    near[2:] += 2 * (h[2:] == h[:-2])
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        index, value = [np.zeros(1, np.int64)], [np.ones(1)]
        if b > a:
            own = near[a:b].copy()
            own[:2] = 0
            for kind in (one[a:b], two[a : b - 1], shape[a:b], shapes[a : b - 1], own + 1):
                if len(kind):
                    at, n = np.unique(kind, return_counts=True)
                    index.append(at)
                    value.append(np.sqrt(n / len(kind)))
        yield np.concatenate(index), np.concatenate(value)


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, p: QualityParams):
        self.p, self.z, self.n = p, np.zeros(p.buckets), np.zeros(p.buckets)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, p = self.z[at], self.p
        shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        g2 = g * g
        step = (np.sqrt(self.n[at] + g2) - np.sqrt(self.n[at])) / self.p.alpha
        np.add.at(self.z, at, g - step * w)
        np.add.at(self.n, at, g2)


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> np.ndarray:
    """Weights by bucket. docs: doc_id, text; labels: doc_id, label (0/1)."""
    runtime.prepare(docs.sparkSession)
    known = labels.where("label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(p.most_labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sparse = "turn long, label int, at array<int>, x array<float>"

    def extract(batches):
        for batch, data, offsets in textscan.chunks(batches):
            rows = list(features(data, offsets, p))
            bounds = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])]).astype(np.int32)
            at, x = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
            yield textscan.batch(turn=batch.column(0), label=batch.column(1), at=pa.ListArray.from_arrays(bounds, at.astype(np.int32)), x=pa.ListArray.from_arrays(bounds, x.astype(np.float32)))

    def fit(batches):
        rows = []
        for b in batches:
            at, x = b.column(2), b.column(3)
            rows += [(t, y, at[i].values.to_numpy(), x[i].values.to_numpy()) for i, (t, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))]
        rows.sort(key=lambda r: r[0])
        model = Ftrl(p)
        for _ in range(p.epochs):
            for _, y, at, x in rows:
                model.learn(at, x.astype(np.float64), y)
        w = model.weights(np.arange(p.buckets))
        at = np.flatnonzero(w)
        yield textscan.batch(at=at.astype(np.int32), w=w[at])

    got = sample.select("turn", "label", "text").mapInArrow(extract, sparse).repartition(1).mapInArrow(fit, "at int, w double").toPandas()
    out = np.zeros(p.buckets)
    out[got["at"].to_numpy()] = got["w"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, score, predicted."""
    spark = runtime.prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(weights)

    def run(batches):
        w = model.value
        for batch, data, offsets in textscan.chunks(batches):
            margin = np.array([w[at] @ x for at, x in features(data, offsets, p)])
            s = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            yield textscan.batch(doc_id=batch.column(0), score=s, predicted=(s >= p.threshold).astype(np.int32))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
