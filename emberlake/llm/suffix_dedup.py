"""Removal of long repeated byte strings by a column-wise suffix order.

Every ``length``-byte string contains the minimum of its hashed ``gram``-byte substrings; equal strings contain it at
the same place. So the positions that are the minimum of some window ("anchors") are found in the scan, and only
stretches around anchors that occur twice can hold repeats. Stretches that are equal throughout are repeats by
themselves. The others, grouped by anchor, go to a column-wise construction: all stretches of a group are aligned at
the anchor, and each round, from the last column to the first, puts one more symbol in front of every stretch's
suffix, updates their order by a stable sort on that symbol (the column of the Burrows-Wheeler transform) and their
common prefixes by range minima. Columns lie in a sequential temporary file of the task, gone with its call, so a round
holds only the order and the prefixes. Neighbours with a common prefix of ``length`` are repeats. As equal strings stand in equal columns, only the
newest suffix of each stretch takes part in a round (the positional form of the transform).

Occurrences are dealt by anchor and told apart in one streaming pass over the sorted rows; anchors that hold more than
a 2,000th of all rows are found first, from the counts of blocks of rows, and go by pre-aggregated counts instead.
A group with more than ``most`` different stretches (a passage in very many contexts) is not gathered: its stretches
are cut into narrower classes of window starts with the longer part that these share as the new group, down to single
windows, where equal ones are told by the same pass.

Texts are UTF-8 bytes; null counts as empty. Matches never cross documents. Rows are told apart by number where a doc_id
is null or repeated, so equal rows are repeats of each other, and all are returned. An empty table gives no rows. Other columns
are carried whatever their names. A very long text is scanned in blocks, at about four bytes of memory for each of its bytes.
Equal stretches are told by a 64-bit hash within an equal 64-bit anchor hash.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlake.llm import runtime, textscan

_U = np.uint64


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200
    gram: int = 40
    most: int = 20_000
    #: Window starts per class after each refinement.
    widths: tuple[int, ...] = (20, 1)
    #: Stretches handled in one construction, unless one group has more.
    together: int = 6_000
    #: Bytes scanned at once.
    block: int = 1 << 17
    #: Anchors with fewer occurrences than this are never hot.
    least_hot: int = 1000

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width values."""
    out, have = x, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = pick(out[:-step], out[step:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, p: RepeatParams) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of consecutive blocks: row, group key, hash of the stretch, first byte and number of window starts,
    missing starts before."""
    valid = np.zeros(len(data) + 1, bool)  # where a window starts
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= p.length:
            valid[a : b - p.length + 1] = True
    for at in range(0, len(data), p.block):
        lo, hi = max(0, at - p.length), min(len(data), at + p.block + p.length)
        own = data[lo:hi]
        n = len(own) - p.gram + 1
        if n < p.window or not valid[lo:hi].any():
            continue
        grams = textscan.window_hash(own, p.gram)
        h = (grams >> _U(32)).astype(np.uint32) | np.uint32(1)
        least = sliding(h, p.window, np.minimum)
        least[~valid[lo : lo + len(least)]] = 0
        padded = np.zeros(len(least) + 2 * (p.window - 1), np.uint32)
        padded[p.window - 1 : p.window - 1 + len(least)] = least
        found = np.flatnonzero(sliding(padded, p.window, np.maximum)[:n] == h)
        found = found[(found >= at - lo) & (found < at - lo + p.block)]
        if len(found):
            yield _stretches(own, grams, offsets, found, lo, p)


def _stretches(own: np.ndarray, grams: np.ndarray, offsets: np.ndarray, found: np.ndarray, base: int, p: RepeatParams) -> dict[str, np.ndarray]:
    at = found + base
    row = np.searchsorted(offsets, at, "right") - 1
    begin, stop = offsets[row], offsets[row + 1]
    lo, hi = np.maximum(begin, at + p.gram - p.length), np.minimum(stop, at + p.length)
    pad = lo - (at + p.gram - p.length)
    whole = _whole(own, lo - base, hi - base, pad, p)
    return {"row": row, "key": textscan.mix(grams[found]), "whole": whole, "lo": lo - begin, "starts": hi - lo - p.length + 1, "pad": pad}


def _whole(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: np.ndarray, p: RepeatParams) -> np.ndarray:
    """Hashes of stretches by three or more windows that together cover them, their length and their column."""
    width = 8 * max(2, p.length // 16)
    h = textscan.window_hash(own, width)
    n = hi - lo
    steps = max(1, -(-(2 * p.length - p.gram) // width))
    out = textscan.mix(n.astype(_U) * _U(1 << 20) + pad.astype(_U))
    for i in range(steps + 1):
        out = textscan.mix(out * _U(0x9E3779B97F4A7C15) + h[lo + (n - width) * i // steps])
    return out


OCCURRENCE = "key long, whole long, row long, lo int, starts short, pad short"


def _occurrences(rows: pa.Array, s: dict[str, np.ndarray]) -> pa.RecordBatch:
    return textscan.batch(
        key=textscan.int64(s["key"]), whole=textscan.int64(s["whole"]), row=rows.take(pa.array(s["row"])),
        lo=s["lo"].astype(np.int32), starts=s["starts"].astype(np.int16), pad=s["pad"].astype(np.int16),
    )


def repeated_starts(segments: list[bytes], pads: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """Column-wise construction over aligned segments. For each segment the starts whose string of ``length`` bytes
    occurs in another segment of its group at the same column (the segment's byte i stands in column pad + i)."""
    m, width = len(segments), int(max(pads[i] + len(s) for i, s in enumerate(segments)))
    matrix = np.full((m, width), -1, np.int16)
    for i, s in enumerate(segments):
        matrix[i, pads[i] : pads[i] + len(s)] = np.frombuffer(s, np.uint8)
    hits: list[list[int]] = [[] for _ in range(m)]
    order = np.argsort(groups, kind="stable")
    group = groups.astype(np.int64) * 257
    common = np.zeros(m, np.int64)  # of each suffix with the one before it in order
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(matrix.T).tobytes())
        del matrix
        for column in range(width - 1, -1, -1):
            file.seek(column * m * 2)
            symbol = np.frombuffer(file.read(m * 2), np.int16)
            rank = (group + symbol + 1)[order]
            place = np.argsort(rank, kind="stable")
            sorted_rank = rank[place]
            follows = np.flatnonzero((sorted_rank[1:] == sorted_rank[:-1]) & (symbol[order[place[1:]]] >= 0)) + 1
            new = np.zeros(m, np.int64)
            if len(follows):
                bounds = np.stack([place[follows - 1] + 1, place[follows] + 1], axis=1).ravel()
                new[follows] = 1 + np.minimum.reduceat(np.append(common, 0), bounds)[::2]
            order, common = order[place], new
            if column <= width - length:
                alike = np.flatnonzero(common >= length)
                for i in np.unique(np.concatenate([order[alike], order[alike - 1]])).tolist() if len(alike) else ():
                    hits[i].append(column - int(pads[i]))
    return [np.array(h[::-1], np.int64) for h in hits]


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte ranges covered by windows at sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


DECIDED = "asked boolean, key long, row long, lo int, starts short, pad short, large boolean"


def _decide(found: DataFrame, p: RepeatParams) -> DataFrame:
    """Of occurrences: asked = false for those whose stretch is equal to another's of their key; asked = true for one of
    each stretch of a key with different stretches, large if the key has more than ``most`` of them."""

    def run(batches):
        state = _Groups(p.most)
        for batch in batches:
            if batch.num_rows:
                yield from state.add(batch)
        yield from state.close()

    return found.repartition("key").sortWithinPartitions("key", "whole").mapInArrow(run, DECIDED)


class _Groups:
    """Streams occurrences sorted by key and stretch; holds at most the ``most`` first stretches of the last key."""

    def __init__(self, most: int):
        self.most = most
        self.kept: list[pa.RecordBatch] = []  # the last stretch's first row, if it is not yet decided
        self.firsts: list[pa.RecordBatch] = []  # first rows of the stretches of the last key
        self.n, self.lone, self.large, self.last = 0, False, False, None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        full = pa.Table.from_batches([*self.kept, batch]).combine_chunks().to_batches()[0]
        key, whole = (full.column(i).to_numpy() for i in (0, 1))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        size[0] += self.more if self.kept else 0
        twin = np.repeat(size > 1, np.diff(np.append(at, len(key))))
        open_at, open_size = at[-1], size[-1]  # the last stretch may go on
        out = twin.copy()
        if self.kept and self.shown:
            out[0] = False
        self.shown = bool(twin[open_at])
        if not self.shown:
            out[open_at] = False
        if out.any():
            yield self._rows(full.filter(pa.array(out)), False, False)
        if len(at) > 1:
            yield from self._stretches(full.take(pa.array(at[:-1])), size[:-1])
        self.kept, self.more = [full.slice(open_at, 1)], int(open_size) - 1

    def _stretches(self, firsts: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stretches that are over, by their first rows. Keys between the first and the last of them are over too."""
        key = firsts.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        yield from self._part(firsts.slice(0, cuts[1]), size[: cuts[1]])
        if len(cuts) > 2:
            n = np.diff(cuts)[1:-1]
            if len(n):
                lone = np.logical_or.reduceat(size[: cuts[-2]] == 1, cuts[1:-2])
                for large in (False, True):
                    pick = np.repeat((n > 1) & lone & ((n > self.most) == large), n)
                    if pick.any():
                        yield self._rows(firsts.slice(cuts[1], len(pick)).filter(pa.array(pick)), True, large)
            yield from self._part(firsts.slice(cuts[-2]), size[cuts[-2] :])

    def _part(self, firsts: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stretches of one key that may have had others before and may have others to come."""
        key = firsts.column(0)[0].as_py()
        if self.last != key:
            yield from self._flush()
        self.last = key
        self.n += len(size)
        self.lone |= bool((size == 1).any())
        self.firsts.append(firsts)
        if self.n > self.most:  # told to be large before the rest of the key is seen
            self.large = True
            yield from self._asked()

    def _asked(self) -> Iterator[pa.RecordBatch]:
        if self.firsts:
            yield self._rows(pa.Table.from_batches(self.firsts).combine_chunks().to_batches()[0], True, self.large)
        self.firsts = []

    def _flush(self) -> Iterator[pa.RecordBatch]:
        if self.large or (self.n > 1 and self.lone):
            yield from self._asked()
        self.firsts, self.n, self.lone, self.large, self.last = [], 0, False, False, None

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            yield from self._stretches(self.kept[0], np.array([self.more + 1]))
            yield from self._flush()

    @staticmethod
    def _rows(batch: pa.RecordBatch, asked: bool, large: bool) -> pa.RecordBatch:
        n = batch.num_rows
        return textscan.batch(asked=pa.array(np.full(n, asked)), key=batch.column(0), row=batch.column(2), lo=batch.column(3), starts=batch.column(4), pad=batch.column(5), large=pa.array(np.full(n, large)))


def _decide_hot(found: DataFrame, total: int, p: RepeatParams) -> DataFrame:
    """As ``_decide``, for the rows of at most 2 * HOT_SHARE keys: counts are made before the shuffle, none gathers a key."""
    classes = found.groupBy("key", "whole").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    alike = runtime.join_hot(found, classes.where("n > 1").select("key", "whole", "n"), ["key", "whole"], "n", total, F.xxhash64("row", "lo"), "inner")
    spans = alike.select(F.lit(False).alias("asked"), "key", "row", "lo", "starts", "pad", F.lit(False).alias("large"))
    firsts = found.groupBy("key", "whole").agg(F.min_by(F.struct("row", "lo", "starts", "pad"), F.struct("row", "lo")).alias("r"))
    todo = firsts.join(F.broadcast(sizes.where("size > 1 and least = 1").select("key", "size")), "key")
    return spans.union(todo.select(F.lit(True).alias("asked"), "key", "r.row", "r.lo", "r.starts", "r.pad", (F.col("size") > p.most).alias("large")))


def _hot_keys(found: DataFrame, total: int, least: int) -> DataFrame:
    """The keys with more than a HOT_SHARE-th of the ``total`` rows (and some with half of that): a key counts in the blocks of rows
    in which it has more than half that share, so of all its rows at most half are missed."""
    block = 64 * runtime.HOT_SHARE

    def run(batches):
        held, n = [], 0

        def flush():
            key, many = np.unique(np.concatenate(held), return_counts=True)
            most = many > n // (2 * runtime.HOT_SHARE)
            return textscan.batch(key=key[most], n=many[most])

        for b in batches:
            held.append(b.column(0).to_numpy())
            n += b.num_rows
            if n >= block:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    counted = found.select("key").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > max(least, total // (2 * runtime.HOT_SHARE))).select("key")


def repeated_spans(docs: DataFrame, scratch: runtime.Scratch, p: RepeatParams = RepeatParams()) -> DataFrame:
    """row, begin, stop: byte ranges that together are covered by repeated strings (they may overlap). docs: row (unique), text."""
    runtime.prepare(docs.sparkSession)
    docs = docs.select("row", "text")

    def scan(batches):
        for batch, data, offsets in textscan.chunks(batches):
            for s in anchors(data, offsets, p):
                yield _occurrences(batch.column(0), s)

    seen = scratch.write(docs.mapInArrow(scan, OCCURRENCE), "level-0")
    spans = []
    for level in range(len(p.widths) + 1):
        total = seen.count()
        hot = scratch.write(_hot_keys(seen, total, p.least_hot), f"hot-{level}")
        decided = _decide(seen.join(F.broadcast(hot), "key", "left_anti"), p)
        if hot.take(1):
            decided = decided.union(_decide_hot(seen.join(F.broadcast(hot), "key", "left_semi"), total, p))
        decided = scratch.write(decided, f"decided-{level}")
        scratch.drop(f"level-{level}")
        alike = decided.where("not asked")
        spans.append(alike.select("row", F.col("lo").alias("begin"), (F.col("lo") + F.col("starts") + (p.length - 1)).cast("int").alias("stop")))
        # dealt before they are gathered: lists made before the shuffle would be longer than their rows
        asked = decided.where("asked").drop("asked").repartition("row").groupBy("row").agg(F.collect_list(F.struct("key", "lo", "starts", "pad", "large")).alias("asked"), F.count("*").alias("asks"))
        # a comparison makes the optimiser see a selective side, and so sift texts by a Bloom filter (of bounded size) before the shuffle: later levels ask few
        asked = scratch.write(asked, f"asked-{level}").where("asks >= 1").select("row", "asked")
        with runtime.bloom_filters(docs.sparkSession):
            cut = scratch.write(_segments(docs, asked, p, p.widths[level] if level < len(p.widths) else 0), f"segments-{level}")
        scratch.drop(f"asked-{level}")
        spans.append(_construct(cut.where("segment is not null").select("key", "row", "lo", "pad", "segment"), p))
        seen = cut.where("segment is null").select("key", "whole", "row", "lo", "starts", "pad")
        if not seen.take(1):
            break
        seen = scratch.write(seen, f"level-{level + 1}")
    out = scratch.write(reduce(DataFrame.union, spans), "spans")
    del spans, seen, alike, decided, asked, cut
    scratch.keep("spans", "rows")
    return out


def _segments(docs: DataFrame, asked: DataFrame, p: RepeatParams, width: int) -> DataFrame:
    """Bytes of the stretches of small groups; of large groups the narrower stretches instead."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = textscan.text_bytes(batch.column(1))
            out: dict[str, list] = {x: [] for x in ("key", "whole", "row", "lo", "starts", "pad", "segment")}
            for i, (row, listed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                for x in listed:
                    lo, starts, pad = x["lo"], x["starts"], x["pad"]
                    if not x["large"]:
                        made = [(x["key"], 0, lo, starts, pad, raw[lo : lo + starts + p.length - 1])]
                    else:
                        # classes of window starts at fixed columns; every window of a class holds the core, the bytes
                        # from the last start of the class to the end of its first window
                        made = []
                        for column in range(pad // width * width, pad + starts, width):
                            a, b = max(column, pad), min(column + width, pad + starts)
                            core = raw[lo + column + width - 1 - pad : lo + column - pad + p.length]
                            own = raw[lo + a - pad : lo + b - pad + p.length - 1]
                            made.append((_digest(core, x["key"], width, column), _digest(own, a - column, b - a), lo + a - pad, b - a, a - column, None))
                    for key, whole, first, n, gap, segment in made:
                        for name, value in zip(out, (key, whole, row, first, n, gap, segment), strict=True):
                            out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())
            yield textscan.batch(**{name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})

    return docs.join(asked, "row").select("row", "text", "asked").mapInArrow(run, OCCURRENCE + ", segment binary")


def _digest(raw: bytes, *numbers: int) -> int:
    key = b"".join(n.to_bytes(8, "little", signed=True) for n in numbers)
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=key).digest(), "little", signed=True)


def _construct(segments: DataFrame, p: RepeatParams) -> DataFrame:
    """Spans of repeated strings in groups of segments. Groups are bounded by p.most segments."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            keys = np.array([x[0] for x in held])
            group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
            hits = repeated_starts([x[4] for x in held], np.array([x[3] for x in held], np.int64), group, p.length)
            doc, begin, stop = [], [], []
            for x, h in zip(held, hits, strict=True):
                if len(h):
                    a, b = _runs(h + x[2], p.length)
                    doc += [x[1]] * len(a)
                    begin += a.tolist()
                    stop += b.tolist()
            return textscan.batch(row=pa.array(doc, pa.int64()), begin=pa.array(begin, pa.int32()), stop=pa.array(stop, pa.int32()))

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= p.together and x[0] != held[-1][0]:
                    yield flush()
                    held = []
                held.append(x)
        if held:
            yield flush()

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, begin int, stop int")


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), carry: list[str] = ["doc_id"], as_text: bool = False) -> DataFrame:  # noqa: B006
    """Per document: the columns named in ``carry`` (other than the results' own), kept (the remaining bytes; or, as text, without
    what is left of characters that are cut through, null for null), spans (array of begin, stop of the removed runs), n_bytes."""
    scratch = runtime.Scratch(runtime.prepare(docs.sparkSession))
    plain = {c: f"c{i}" for i, c in enumerate(carry) if c not in ("kept", "spans", "n_bytes")}  # so that no column's name meets one of ours
    rows, _ = runtime.row_keys(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in plain.items())), scratch)
    spans = repeated_spans(rows, scratch, p)
    packed = F.shiftleft(F.col("begin").cast("long"), 32) + F.col("stop")
    listed = spans.select("row", packed.alias("span")).repartition("row").groupBy("row").agg(F.collect_list("span").alias("listed"))
    shown = rows.select("row", *plain.values(), "text").join(listed, "row", "left").select(*plain.values(), "text", "listed")
    own = len(plain)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = textscan.text_bytes(batch.column(own))
            kept, begins, stops, ptr = [], [], [], [0]
            lists = batch.column(own + 1)
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                if lists[i].is_valid:
                    v = np.sort(lists[i].values.to_numpy())
                    a, b = v >> 32, np.maximum.accumulate(np.minimum(v & 0xFFFFFFFF, len(text)))
                    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                    a, b = a[new], b[np.append(new[1:] - 1, len(b) - 1)]
                    between = zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)
                    text = np.concatenate([text[x:y] for x, y in between])
                    begins += a.tolist()
                    stops += b.tolist()
                raw = text.tobytes()
                kept.append(raw if not as_text else raw.decode("utf-8", "ignore") if batch.column(own)[i].is_valid else None)
                ptr.append(len(begins))
            item = pa.StructArray.from_arrays([pa.array(begins, pa.int64()), pa.array(stops, pa.int64())], ["begin", "stop"])
            made = {"_kept": pa.array(kept, pa.string() if as_text else pa.binary()), "_spans": pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), item), "_n": pa.array(np.diff(offsets))}
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *made.values()], names=[*plain.values(), *made])

    made = StructType.fromDDL(f"_kept {'string' if as_text else 'binary'}, _spans array<struct<begin:long,stop:long>>, _n long")
    done = shown.mapInArrow(run, StructType([*(shown.schema[c] for c in plain.values()), *made]))
    return done.select(*(F.col(n).alias(c) for c, n in plain.items()), F.col("_kept").alias("kept"), F.col("_spans").alias("spans"), F.col("_n").alias("n_bytes"))
