"""Benchmark decontamination by spaced-seed hashing.

Words (lower-cased) of tests and documents are hashed under fixed masks that ignore some positions of a window, so a
substituted word under an ignored position does not hide a copy. The hashes of both are joined; where a document's window
equals a test's, the two
are laid side by side on that diagonal and the stretch with the best score (1 per equal word, -``penalty`` per
unequal) is taken; it counts if it spans at least ``least_words`` words (or the whole test, if shorter) and at least
``similarity`` of them are equal.

The default masks miss nothing from a similarity of 0.8 and a span of 13 on: k substitutions in n words leave n - k equal
words in k + 1 runs. Up to two leave a run of 4 as n >= 13; three leave one if n >= 16, and in n = 15 either one or the
runs 3, 3, 3, 3, which the second mask spans; four and more leave 4k equal words or more, over 3 (k + 1). Tests with
fewer than 13 words must be met whole: they are cut into more pieces than substitutions allowed, with a mask for every
choice of pieces left out. Diagonals with too few equal words in all are dropped before they are looked at closely.

Any number of tests works: their hashes are a table, and only a bitmap of at most 2**MOST_BITS bits is broadcast, which
keeps most windows of the documents out of the join (and fewer of them the more tests there are). Seeds that are frequent in the
documents are dealt over several tasks. Words are told apart by their bytes when a stretch is verified.

Null texts and texts without words, of either table, match nothing; tests without item_id are not searched; empty tables
give no rows. Repeated tests and rows are searched alike: a pair of ids is reported once, with its largest stretch (the
first of equally large ones). Other columns, whatever their names, are kept by ``remove_leaks``, which judges each row by its own
text and keeps rows without doc_id. Very long texts are scanned whole, at about ten bytes of memory for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan

SCHEMA = "doc_id long, item_id long, first_word long, n_words long, n_equal long, similarity double"
PROVED = 13  # words from which on the masks of SeedParams miss nothing
MOST_BITS = 22


@dataclass(frozen=True)
class SeedParams:
    masks: tuple[str, ...] = ("1111", "1110111")
    least_words: int = 13
    similarity: float = 0.8
    penalty: float = 2.0


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers lo .. lo + n - 1 of all rows, and the row of each."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (lo - (np.cumsum(n) - n))[of], of


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of len(mask) words, ignoring the positions marked 0."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[j : j + n]
            out ^= out >> np.uint64(31)
    return textscan.mix(out)


def whole_masks(n: int, similarity: float) -> list[str]:
    """Masks of n positions of which one at least is met by every n words with ``similarity`` of them equal."""
    wrong = max(k for k in range(n + 1) if n - k >= similarity * n)
    pieces = np.array_split(np.arange(n), min(n, wrong + 4)) if wrong else []
    out = []
    for left_out in combinations(pieces, wrong):
        mask = np.ones(n, int)
        mask[np.concatenate([np.zeros(0, int), *left_out])] = 0
        out.append("".join(map(str, mask)))
    return out


def seeds(h: np.ndarray, ptr: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (in the row) of every window of a mask's length that lies within a row."""
    out = []
    for m in masks:
        n = np.maximum(np.diff(ptr) - len(m) + 1, 0)
        at, row = _ranges(ptr[:-1], n)
        out.append((seed_hashes(h, m)[at] if len(at) else np.zeros(0, np.uint64), row, at - ptr[row] if len(at) else at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def masks_of(n: int, p: SeedParams) -> list[str]:
    """The masks for tests of n words."""
    return list(p.masks) if n >= PROVED else whole_masks(n, p.similarity)


def _portions(n: np.ndarray, most: int = 1 << 20) -> list[np.ndarray]:
    """Indexes of n > 0, cut where the sum of n passes multiples of ``most``."""
    some = np.flatnonzero(n)
    return np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // most)) + 1) if len(some) else []


def enough(doc: np.ndarray, test: np.ndarray, starts: np.ndarray, p: SeedParams) -> np.ndarray:
    """Whether each diagonal (start of the test in doc) has as many equal words in all as the least stretch that counts."""
    lo, hi = np.maximum(starts, 0), np.minimum(starts + len(test), len(doc))
    same = np.zeros(len(starts), np.int64)
    for own in _portions(hi - lo):
        at, of = _ranges(lo[own], (hi - lo)[own])
        equal = doc[at] == test[at - starts[own][of]]
        same[own] = np.bincount(of[equal], minlength=len(own))
    return same >= p.similarity * min(len(test), p.least_words)


def verify(doc: np.ndarray, test: np.ndarray, start: int, p: SeedParams) -> tuple[int, int, int] | None:
    """First word, span and equal words of the best stretch on one diagonal."""
    lo, hi = max(0, start), min(len(doc), start + len(test))
    if hi <= lo:
        return None
    equal = doc[lo:hi] == test[lo - start : hi - start]
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -p.penalty))])
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    first = int(np.argmin(total[: end + 1]))
    span, same = end - first, int(equal[first:end].sum())
    if span < min(p.least_words, len(test)) or same < p.similarity * span:
        # a short stretch may still be part of a whole test that is near enough
        first, span, same = 0, hi - lo, int(equal.sum())
        if span < min(len(test), p.least_words) or same < p.similarity * span:
            return None
    return lo + first, span, same


def best_overlap(doc: np.ndarray, test: np.ndarray, starts: np.ndarray, p: SeedParams) -> tuple[int, int, int] | None:
    """The largest stretch over the diagonals: most equal words, then words, then the first."""
    found = [v for s in np.unique(starts[enough(doc, test, starts, p)]).tolist() if (v := verify(doc, test, s, p))]
    return max(found, key=lambda v: (v[2], v[1], -v[0]), default=None)


def _seed_rows(texts: DataFrame, key: str, masks: list[str], kinds: dict[int, list[str]] | None, bitmap) -> DataFrame:
    """hash, key and at (first word) of the windows of each text: under the masks of its number of words where ``kinds`` gives
    these, else under all masks; only those in the bitmap, where there is one."""

    def run(batches):
        for batch, data, offsets in textscan.chunks(batches):
            _, _, h, ptr = textscan.word_hashes(data, offsets)
            if kinds is None:
                found = [seeds(h, ptr, masks)]
            else:
                n = np.minimum(np.diff(ptr), PROVED)
                found = []
                for size, own in kinds.items():
                    got = seeds(h, ptr, own)
                    found.append(tuple(x[n[got[1]] == size] for x in got))
            for hashes, row, at in found:
                if bitmap is not None:
                    bits, width = bitmap.value
                    place = (hashes >> np.uint64(64 - width)).astype(np.int64)
                    near = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    hashes, row, at = hashes[near], row[near], at[near]
                if len(hashes):
                    yield textscan.batch(hash=textscan.int64(hashes), key=batch.column(0).take(pa.array(row)), at=at.astype(np.int32))

    return texts.select(key, "text").mapInArrow(run, "hash long, key long, at int").withColumnRenamed("key", key)


def _bitmap(hashes: DataFrame):
    """Broadcast (packed bits, width) of the leading bits of the hashes; at most 2**MOST_BITS places come to the driver."""
    n = hashes.count()
    width = min(MOST_BITS, max(8, int(64 * n).bit_length()))
    places = hashes.select(F.shiftrightunsigned("hash", 64 - width).cast("int").alias("place")).distinct().toPandas()["place"].to_numpy(np.int64)
    bits = np.zeros(1 << width, np.uint8)
    bits[places] = 1
    return hashes.sparkSession.sparkContext.broadcast((np.packbits(bits, bitorder="little"), width))


def _leaks(rows: DataFrame, tests: DataFrame, scratch: runtime.Scratch, p: SeedParams) -> DataFrame:
    """row, item_id and the largest stretch of every overlap. rows: row (unique), text."""
    tests = tests.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    tests = scratch.write(tests.withColumn("test", F.monotonically_increasing_id()), "tests")

    def sizes(batches):
        for _, data, offsets in textscan.chunks(batches):
            found = np.unique(np.minimum(np.diff(textscan.words(data, offsets)[2]), PROVED))
            yield textscan.batch(n=found[found > 0].astype(np.int32))

    kinds = {r["n"]: masks_of(r["n"], p) for r in tests.select("text").mapInArrow(sizes, "n int").distinct().orderBy("n").collect()}
    masks = list(dict.fromkeys(m for own in kinds.values() for m in own)) or list(p.masks)
    wanted = scratch.write(_seed_rows(tests, "test", masks, kinds, None), "seeds")
    hits = scratch.write(_seed_rows(rows, "row", masks, None, _bitmap(wanted)), "hits")
    counted = wanted.join(hits.groupBy("hash").agg(F.count("*").alias("n")), "hash").select("hash", "test", F.col("at").alias("test_at"), "n")
    met = runtime.join_hot(hits, counted, ["hash"], "n", hits.count(), F.xxhash64("row", "at"), "inner")
    pairs = met.select("row", "test", (F.col("at") - F.col("test_at")).alias("start")).groupBy("row", "test").agg(F.collect_set("start").alias("starts"))
    pairs = scratch.write(pairs, "pairs")
    shown = pairs.join(tests.withColumnRenamed("text", "asked"), "test").join(rows.select("row", "text"), "row")

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _checked(batch, p)

    checked = shown.select("row", "item_id", "starts", "text", "asked").mapInArrow(check, "row long, item_id long, first_word long, n_words long, n_equal long")
    return checked.withColumn("similarity", F.col("n_equal") / F.col("n_words"))


def _checked(batch: pa.RecordBatch, p: SeedParams) -> Iterator[pa.RecordBatch]:
    of = {}  # place of the first of each distinct row's text
    for i, x in enumerate(batch.column(0).to_pylist()):
        of.setdefault(x, i)
    texts = pa.concat_arrays([batch.column(3).take(pa.array(list(of.values()))), batch.column(4)])
    data, offsets = textscan.text_bytes(texts)
    low = textscan.LOWER[data]
    starts, ends, ptr = textscan.words(low, offsets)
    _, word = textscan.factorize(low, starts, ends)
    turn = {x: i for i, x in enumerate(of)}
    out = []
    for i, (row, item, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
        d, t = turn[row], len(of) + i
        got = best_overlap(word[ptr[d] : ptr[d + 1]], word[ptr[t] : ptr[t + 1]], np.array(diagonals, np.int64), p)
        if got:
            out.append((row, item, *got))
    if out:
        row, item, first, span, same = (np.array(x, np.int64) for x in zip(*out, strict=True))
        yield textscan.batch(row=row, item_id=item, first_word=first, n_words=span, n_equal=same)


def find_leaks(docs: DataFrame, tests: DataFrame, p: SeedParams = SeedParams()) -> DataFrame:
    """One row per document and test that overlap, with the largest stretch. docs: doc_id, text; tests: item_id, text."""
    scratch = runtime.Scratch(runtime.prepare(docs.sparkSession))
    rows, unique = runtime.row_keys(docs.select("doc_id", "text"), scratch)
    found = _leaks(rows, tests, scratch, p)
    found = found.withColumnRenamed("row", "doc_id") if unique else found.join(rows.select("row", "doc_id"), "row")
    best = F.max_by(F.struct("first_word", "n_words", "n_equal", "similarity"), F.struct("n_equal", "n_words", -F.col("first_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def remove_leaks(docs: DataFrame, tests: DataFrame, p: SeedParams = SeedParams()) -> DataFrame:
    """The rows that overlap no test, with all their columns."""
    scratch = runtime.Scratch(runtime.prepare(docs.sparkSession))
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column's name meets one of ours
    plain = docs.select(*(F.col(c).alias(n) for c, n in own.items()))
    rows, _ = runtime.row_keys(plain, scratch, own["doc_id"])
    found = scratch.write(_leaks(rows.select("row", F.col(own["text"]).alias("text")), tests, scratch, p).select("row").distinct(), "leaking")
    return rows.join(found, "row", "left_anti").select(*(F.col(n).alias(c) for c, n in own.items()))
