"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; n-grams of 1 to 4 code points are hashed into ``buckets`` counters. Training counts come
from the ``most_labelled`` labelled rows with the smallest id hashes (a documented bound; whole texts), are summed
by language and bucket, and become a log-probability matrix, which is broadcast in blocks of ``at_once`` languages
(at most ``at_once`` * ``buckets`` numbers each); a text's best language and probability are carried from block to block.
Scoring sums matrix rows of each text in sparse batches. Ties go to the language first in order.

Texts that are null or hold no letter give ``und`` with score 0; so does every text if nothing is labelled, as in an empty
table. Rows without doc_id, and rows that repeat one, are scored by their own text; for training a repeated id brings all its rows. Columns named in
``carry`` are passed on whatever their names; one named ``lang_pred`` or ``score`` gives way to the result. Long
texts are taken in blocks of ``block`` code points, at about fifteen bytes of memory for each byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan

HASH = np.uint32(2654435761)
STEP = np.uint32(40503)


@dataclass(frozen=True)
class LanguageParams:
    buckets: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3, 4)
    smoothing: float = 0.5
    most_labelled: int = 20_000
    at_once: int = 256
    block: int = 1 << 16
    #: Weight of each n-gram: overlapping n-grams repeat the same evidence.
    weight: float = 0.25



def ngram_buckets(texts: pa.Array, p: LanguageParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of code points and each order: bucket of each n-gram that starts there, and the row it belongs to."""
    low = [t.lower() if t else "" for t in texts.to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    del low
    longest = max(p.orders)
    for lo in range(0, len(code), p.block):
        own = code[lo : lo + p.block + longest - 1]
        here = min(p.block, len(code) - lo)
        at = np.arange(lo, lo + here)
        row = np.searchsorted(ends, at, "right")
        left = ends[row] - at
        h = np.zeros(len(own), np.uint32)
        for n in range(1, longest + 1):
            m = len(own) - n + 1
            if m <= 0:
                break
            h = h[:m] * STEP + own[n - 1 : n - 1 + m]
            if n in p.orders:
                k = min(m, here)
                g = h[:k] * HASH
                g ^= g >> np.uint32(15)
                g += np.uint32(n * 7919)
                g *= np.uint32(0x85EBCA6B)
                inside = left[:k] >= n
                yield (g >> np.uint32(16))[inside].astype(np.int64) % p.buckets, row[:k][inside]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, p: LanguageParams = LanguageParams()) -> tuple[list[str], np.ndarray]:
    """docs: doc_id, text, lang. The language list and the matrix languages x buckets of log probabilities."""
    runtime.prepare(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.most_labelled)
    chosen = chosen.distinct().withColumnRenamed("doc_id", "id")
    sample = labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")))

    def count(batches):
        langs: dict[str, np.ndarray] = {}

        def flush():
            for x in sorted(langs):
                at = np.flatnonzero(langs[x])
                yield textscan.batch(lang=pa.array([x] * len(at), pa.string()), bucket=at.astype(np.int32), n=langs[x][at])
            langs.clear()

        for batch, _, _ in textscan.chunks(batches):
            names = batch.column(1).to_pylist()
            kinds = sorted(set(names))
            if len(langs) + len(kinds) > 64 and langs:
                yield from flush()
            turn = {x: i for i, x in enumerate(kinds)}
            of = np.array([turn[x] for x in names], np.int64)
            for bucket, row in ngram_buckets(batch.column(0), p):
                cell, n = np.unique(of[row] * p.buckets + bucket, return_counts=True)
                cuts = np.searchsorted(cell, np.arange(len(kinds) + 1) * p.buckets)
                for i, x in enumerate(kinds):
                    if x not in langs:
                        langs[x] = np.zeros(p.buckets, np.int64)
                    langs[x][cell[cuts[i] : cuts[i + 1]] - i * p.buckets] += n[cuts[i] : cuts[i + 1]]
        yield from flush()

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most buckets rows for each language of the sample
    names = sorted(set(got["lang"]))
    counts = np.full((len(names), p.buckets), p.smoothing, np.float32)
    turn = {x: i for i, x in enumerate(names)}
    counts[got["lang"].map(turn).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy()
    return names, np.log(counts / counts.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, p: LanguageParams = LanguageParams(), carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns named in ``carry``, lang_pred, score (posterior probability of lang_pred under equal priors)."""
    spark = runtime.prepare(docs.sparkSession)
    carry = [c for c in carry if c not in ("lang_pred", "score")]
    own = {c: f"c{i}" for i, c in enumerate(carry)}
    out = docs.select(*(F.col(c).alias(n) for c, n in own.items()), F.col("text").alias("t"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("mass"))
    for lo in range(0, len(langs), p.at_once):
        model = spark.sparkContext.broadcast((langs[lo : lo + p.at_once], np.ascontiguousarray(matrix[lo : lo + p.at_once])))
        out = _scored(out, model, p)
    known = F.col("best").isNotNull()
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), F.when(known, F.col("best")).otherwise("und").alias("lang_pred"), F.when(known, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def _scored(docs: DataFrame, model, p: LanguageParams) -> DataFrame:
    """docs with best (the likeliest language so far; null for texts without letters), top (its log probability) and mass
    (the sum of all languages' probabilities over the best one's)."""
    n_own = len(docs.columns) - 4

    def score(batches):
        names, logp = model.value
        for batch, _, _ in textscan.chunks(batches, "t"):
            texts, n = batch.column(n_own), batch.num_rows
            total = np.zeros((n, len(names)))
            for bucket, row in ngram_buckets(texts, p):
                if len(row):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    for i in range(len(names)):
                        total[row[first], i] += np.add.reduceat(logp[i][bucket], first, dtype=np.float64)
            total *= p.weight
            at = total.argmax(1)
            here = total[np.arange(n), at]
            before = batch.column(n_own + 2).to_numpy(zero_copy_only=False)
            before = np.where(np.isnan(before), -np.inf, before)
            top = np.maximum(here, before)
            mass = np.exp(total - top[:, None]).sum(1) + batch.column(n_own + 3).to_numpy() * np.exp(before - top)
            known = [_has_letter(t) for t in texts.to_pylist()]
            best = [(names[a] if h > b else old) if k else None for k, a, h, b, old in zip(known, at, here, before, batch.column(n_own + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_own + 1], pa.array(best, pa.string()), pa.array(top), pa.array(mass)], names=batch.schema.names)

    return docs.mapInArrow(score, docs.schema)
