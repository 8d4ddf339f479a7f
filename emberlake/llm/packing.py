"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokenising and packing happen in the scan task. Each task packs its own stream by bounded-space online best-fit:
at most ``open_bins`` sequences are open, filed by free space, with a bitset over the free sizes; an item goes to
the fullest open sequence that holds it, and when a new one is needed and all are open, the fullest closes. Items
come in blocks of a scanned chunk, longest first. What tasks leave part-filled is packed once more, whole sequences
as items, by the same rule: tasks of about ``second_part`` sequences, dealt by hash, each in blocks of ``block`` sequences, longest
first, with at most ``open_bins`` open.

Null texts are empty: such a document is one piece that holds only the end id. Repeated doc_ids are packed row by row.
Only documents longer than ``capacity`` are cut. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan

END_ID = 1
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


@dataclass(frozen=True)
class PackParams:
    capacity: int = 4096
    open_bins: int = 128
    second_part: int = 200_000
    block: int = 16_384


class BestFit:
    """Open bins filed by free space; ``place`` gives the bin number and the offset in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.open, self.made = capacity, open_bins, 0, 0
        self.bits = 0
        self.filed: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        found = self.filed[free].pop()
        if not self.filed[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        if free > length:
            self.filed.setdefault(free - length, []).append(number)
            self.bits |= 1 << (free - length)
            self.open += 1
        return number, self.capacity - free


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy of twice the size where n entries do not fit."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class WordTokenizer:
    """Ids of a lower-casing word BPE, equal to ``tokenizers``' own.

    Text of ASCII and Latin-1 letters is split into runs of letters, single digits and runs of other signs by byte
    class; distinct runs are encoded once per worker, filed by their bytes. Any other text, and any chunk in which the
    library does not close each run as one word, is encoded by the library as a whole.
    """

    MOST_CACHED = 1 << 19

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for word, i in vocabulary.items():
            self.ends[i] = word.endswith("</w>")
        self._forget()
        low = textscan.LOWER
        kind = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other sign, 9 not handled here
        kind[np.arange(97, 123)] = 1
        kind[np.arange(65, 91)] = 1
        kind[np.arange(48, 58)] = 2
        kind[[0x20, 9, 10, 11, 12, 13]] = 0
        kind[:9] = kind[14:32] = kind[127] = kind[ord("'")] = 9
        kind[128:] = 9
        kind[0xC3] = 1
        kind[0x80:0xC0] = 1
        self.kind, self.low = kind, low

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.bounds, self.n_ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and the place of each row's first id."""
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        kind = self.kind[data]
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        odd = kind == 9
        odd |= (second | (data == 0xC3)) != (data >= 0x80)  # only pairs C3 xx
        odd |= second & ((data == 0x97) | (data == 0xB7))  # the signs for times and division
        odd[1:] |= (data[1:] == ord("|")) & (data[:-1] == ord("<"))  # spelled special tokens
        slow = np.zeros(n, bool)
        slow[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        low = self.low[data]
        upper = second & (data >= 0x80) & (data < 0x9F)
        low[upper] += 32
        starts_run = np.ones(len(data), bool)
        starts_run[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts_run[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts_run)
        ends = np.append(starts[1:], len(data))
        keep = (kind[starts] != 0) & ~slow[np.searchsorted(offsets, starts, "right") - 1]
        starts, ends = starts[keep], ends[keep]
        first, inverse = textscan.factorize(low, starts, ends)
        if len(self.slots) > self.MOST_CACHED:
            self._forget()
        raw = low.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slot = list(map(self.slots.get, keys))
        new = [i for i, s in enumerate(slot) if s is None]
        if new:
            ids = np.array(self.library.encode(b" ".join([keys[i] for i in new]).decode(), add_special_tokens=False).ids, np.int64)
            closed = np.flatnonzero(self.ends[ids]) + 1
            if len(closed) != len(new):
                return self._by_library(data, offsets)
            base, known = len(self.slots), self.n_ids
            for j, i in enumerate(new):
                slot[i] = self.slots[keys[i]] = base + j
            self.n_ids += len(ids)
            self.ids, self.bounds = _room(self.ids, self.n_ids), _room(self.bounds, len(self.slots) + 1)
            self.ids[known : self.n_ids] = ids
            self.bounds[base + 1 : len(self.slots) + 1] = closed + known
        of = np.array(slot, np.int64)[inverse] if len(slot) else np.zeros(0, np.int64)
        counts = self.bounds[of + 1] - self.bounds[of]
        ptr = np.concatenate([[0], np.cumsum(counts)])
        flat = np.arange(ptr[-1]) + np.repeat(self.bounds[of] - ptr[:-1], counts)
        ids, rows = self.ids[flat], ptr[np.searchsorted(starts, offsets)]
        if slow.any():
            odd_ids, odd_rows = self._by_library(data, np.stack([offsets[:-1], offsets[1:]], axis=1)[slow])
            parts, turn = [], iter(range(len(odd_rows) - 1))
            for i in range(n):
                if slow[i]:
                    j = next(turn)
                    parts.append(odd_ids[odd_rows[j] : odd_rows[j + 1]])
                else:
                    parts.append(ids[rows[i] : rows[i + 1]])
            ids, rows = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, rows

    def _by_library(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and places as from ``encode``, text by text. offsets: of all rows in a row, or (start, end) of each."""
        bounds = offsets if offsets.ndim == 2 else np.stack([offsets[:-1], offsets[1:]], axis=1)
        own = [np.array(self.library.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int64) for a, b in bounds.tolist()]
        return np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The tokenizer of this worker process for a vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path].encode


def _pieces(doc_ids: np.ndarray, ids: np.ndarray, rows: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc_id, piece, start, length, crc) of each piece; each document closes with END_ID."""
    raw = ids.astype("<u4")
    end = np.array([END_ID], "<u4").tobytes()
    for doc, a, b in zip(doc_ids, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        own = raw[a:b].tobytes() + end
        for piece, start in enumerate(range(0, b - a + 1, capacity)):
            length = min(capacity, b - a + 1 - start)
            yield doc, piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return textscan.batch(
        doc_id=pa.array(c[0], pa.int64()), piece=pa.array(c[1], pa.int32()), start=pa.array(c[2], pa.int64()), length=pa.array(c[3], pa.int64()),
        ids_crc32=pa.array(c[4], pa.int64()), bin=pa.array(c[5], pa.int64()), offset=pa.array(c[6], pa.int64()),
    )


def pack(docs: DataFrame, vocabulary: str, p: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: the tokenizer's file."""
    spark = runtime.prepare(docs.sparkSession)
    scratch = runtime.Scratch(spark)

    def first(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 36
        encode, bins = word_tokenizer(vocabulary), BestFit(p.capacity, p.open_bins)
        for batch, data, offsets in textscan.chunks(batches, most=2 << 20):
            ids, rows = encode(data, offsets)
            out = []
            for x in sorted(_pieces(batch.column(0).to_pylist(), ids, rows, p.capacity), key=lambda x: -x[3]):
                number, offset = bins.place(x[3])
                out.append((*x, task + number, offset))
            yield _columns(out)

    pieces = scratch.write(docs.select("doc_id", "text").mapInArrow(first, SCHEMA), "pieces")
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    partial = scratch.write(fills.where(F.col("fill") < p.capacity), "partial")
    parts = 1 + partial.count() // p.second_part

    def second(batches):
        from pyspark import TaskContext

        task = (TaskContext.get().partitionId() << 36) + (1 << 62)
        bins, held = BestFit(p.capacity, p.open_bins), []

        def placed(block):
            out = [(old, *bins.place(fill)) for old, fill in sorted(block, key=lambda x: (-x[1], x[0]))]
            old, number, base = (np.array(c, np.int64) for c in zip(*out, strict=True))
            return textscan.batch(bin=old, sequence_id=task + number, base=base)

        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            while len(held) >= p.block:
                yield placed(held[: p.block])
                held = held[p.block :]
        if held:
            yield placed(held)

    moved = partial.repartition(parts, "bin").mapInArrow(second, "bin long, sequence_id long, base long")
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
