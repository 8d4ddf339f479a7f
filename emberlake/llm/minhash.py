"""Near-duplicate classes of documents by SetSketch registers.

A document's set holds the distinct hashes of its ``k``-word shingles. Register i of a sketch is the truncated
minimum of exponential variates over the set, on a scale of powers of ``base``: registers of a union are the maxima of
the parts' registers. Documents whose registers agree throughout a band are candidates; the Jaccard similarity is then
estimated by maximum likelihood from the numbers of greater, smaller and equal registers and the known set sizes, and
candidates within reach of the threshold are verified on the full sets.

Documents with equal sets form one class from the start, so copies are never paired. Within a band's bucket, members
are first compared with one leader each, not with each other. Members of a bucket that still lie in different
components are then compared by their sketches, first for their likeliest partner, then for all partners; pairs within a
component need no further link, so none are made. Large buckets are compared in blocks of bounded size, many tasks a bucket. Candidates carry finer sketches for this (the low bytes of
more registers), so that of a family of texts just under the threshold of each other few pairs are left to verify. No cap
drops a pair: what can be missed is a pair that meets in no band, with probability (1 - s**rows)**bands, 3e-6 at similarity
s = 0.8, or is estimated over four standard errors too low.

Classes of equal sets are told by the set's size and two independent 64-bit hashes of it; pairs are verified on words
told apart by their bytes.

Null texts and texts without words have an empty set and link to nothing; an empty table gives no rows. Rows are told
apart by number where a doc_id is null or repeated, so equal rows are copies of each other, and rows that share a doc_id but not the text are
judged by their own texts. Rows without doc_id link like others but name no component and are not kept. Other columns,
whatever their names, are not read. A very long text is one set, at about 30 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan
from emberlake.llm.components import components


@dataclass(frozen=True)
class SketchParams:
    k: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    #: Candidates estimated below this much under the threshold are not verified (over four standard errors of 96 registers).
    slack: float = 0.18
    #: Registers of candidates beyond those of the bands (low bytes only), and the slack of all registers together (over four standard errors of 1,024).
    fine: int = 928
    fine_slack: float = 0.058
    #: Rows, and columns, of a block: a bucket with more members is compared in several blocks.
    block: int = 2048

    @property
    def registers(self) -> int:
        return self.bands * self.rows


LIMIT = (1 << 16) - 1
SLICE = 1 << 15


def _multipliers(n: int) -> np.ndarray:
    return textscan.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(sets: list[np.ndarray], p: SketchParams, first: int = 0, many: int | None = None) -> np.ndarray:
    """Sketches of non-empty sets, one row each: floor(1 - log_base(least exponential variate)), cut to 0..LIMIT.
    ``many`` registers from number ``first`` on (those of the bands, if not given)."""
    many = p.registers if many is None else many
    out = np.empty((len(sets), many), np.uint16)
    multipliers = _multipliers(first + many)[first:]
    sizes = np.array([len(s) for s in sets])
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))  # slices of about SLICE hashes stay in the cache
    for lo, hi in zip(cuts, [*cuts[1:], len(sets)], strict=True):
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        least = np.empty((many, hi - lo), np.uint64)
        for i, m in enumerate(multipliers):
            v = flat * m
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            least[i] = np.minimum.reduceat(v, starts)
        x = (least + 1.0) / 2.0**64
        np.minimum(x, 1 - 2**-53, out=x)
        x = -np.log1p(-x) / p.rate
        out[lo:hi] = np.clip(np.floor(1 - np.log(x) / np.log(p.base)), 0, LIMIT).T
    return out


def band_keys(sketch: np.ndarray, p: SketchParams) -> np.ndarray:
    """For each row the hash of each band of registers."""
    r = sketch.reshape(len(sketch), p.bands, p.rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), r.shape[:2]).copy()
    for j in range(p.rows):
        out = textscan.mix(out * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, given set sizes."""
    greater, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - greater - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    unlike = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base), 1e-12, 1)
    up, down = unlike(u[:, None] - v[:, None] * grid), unlike(v[:, None] - u[:, None] * grid)
    fit = greater[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return grid[np.arange(len(grid)), fit.argmax(1)]


def sketch_documents(docs: DataFrame, p: SketchParams) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (independent hashes of the set), regs (binary), keys (band hashes; null if the set is empty)."""
    runtime.prepare(docs.sparkSession)

    def run(batches):
        for batch, data, offsets in textscan.chunks(batches):
            low = textscan.LOWER[data]
            begin, end, ptr = textscan.words(low, offsets)
            sets, other = (textscan.shingle_sets(textscan.range_hash(low, begin, end, lane), ptr, p.k) for lane in (0, 1))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            regs: list[bytes | None] = [None] * len(sets)
            keys: list[np.ndarray | None] = [None] * len(sets)
            for s, of in ((s1, sets), (s2, other)):
                for i in full.tolist():
                    s[i] = textscan.mix(of[i]).sum()
            if len(full):
                sketch = registers([sets[i] for i in full], p)
                for i, r, k in zip(full.tolist(), sketch, band_keys(sketch, p).view(np.int64), strict=True):
                    regs[i], keys[i] = r.tobytes(), k
            yield textscan.batch(doc_id=batch.column(0), n=n, s1=textscan.int64(s1), s2=textscan.int64(s2), regs=pa.array(regs, pa.binary()), keys=pa.array(keys, pa.list_(pa.int64())))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary, keys array<long>")


def _fine_texts(texts: DataFrame, p: SketchParams) -> DataFrame:
    """doc_id, text and the fine registers (binary; null if the set is empty)."""

    def run(batches):
        for batch, data, offsets in textscan.chunks(batches):
            _, _, h, ptr = textscan.word_hashes(data, offsets)
            sets = textscan.shingle_sets(h, ptr, p.k)
            full = [i for i, s in enumerate(sets) if len(s)]
            fine: list[bytes | None] = [None] * len(sets)
            if full:
                for i, r in zip(full, (registers([sets[i] for i in full], p, p.registers, p.fine) & 255).astype(np.uint8), strict=True):
                    fine[i] = r.tobytes()
            yield textscan.batch(doc_id=batch.column(0), text=batch.column(1), fine=pa.array(fine, pa.binary()))

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, fine binary")


def exact_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the numbers of its distinct k-word shingles; equal numbers, equal words by their bytes."""
    low = textscan.LOWER[data]
    starts, ends, ptr = textscan.words(low, offsets)
    _, word = textscan.factorize(low, starts, ends)
    many = int(word.max()) + 1 if len(word) else 1
    of, whole = word, {}
    for turn in range(1, k + 1):  # of: number of each run of ``turn`` words
        if turn > 1:
            _, of = np.unique(of[:-1] * many + word[turn - 1 :], return_inverse=True)
        whole[turn] = of
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[k][a : b - k + 1]))
        else:  # a shorter text is one shingle of its own kind
            out.append(np.array([-((int(whole[b - a][a]) + 1) * k + b - a)]) if b > a else np.zeros(0, np.int64))
    return out


def _near(n: str, m: str, p: SketchParams):
    return (100 * F.least(n, m) >= p.percent * F.greatest(n, m)) & (F.col(n) > 0)


def _likely(pairs: DataFrame, candidates: DataFrame, p: SketchParams) -> DataFrame:
    """Of the pairs (a, b) those whose estimate is in reach of the threshold."""
    side = lambda x: candidates.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(estimate(a, b, n_a, n_b, p.base) >= p.percent / 100 - p.slack))

    columns = ["a", "b", "regs_a", "regs_b", "n_a", "n_b"]
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near("n_a", "n_b", p)).select(columns).mapInArrow(likely, "a long, b long")


def _verified(candidates: DataFrame, texts: DataFrame, p: SketchParams) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""

    def exact(batches):
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, 64)
                lo += 64
                ids = [part.column(i).to_pylist() for i in (0, 1)]
                at: dict[int, tuple[int, int]] = {}  # row and side of each document's text
                for side in (0, 1):
                    for j, x in enumerate(ids[side]):
                        at.setdefault(x, (j, side))
                texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array([j + side * part.num_rows for j, side in at.values()]))
                sets = dict(zip(at, exact_sets(*textscan.text_bytes(texts), p.k), strict=True))
                keep = []
                for s, t in zip(*([sets[x] for x in side] for side in ids), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= p.percent * (len(s) + len(t) - both) and both > 0)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    shown = candidates.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return shown.mapInArrow(exact, "a long, b long")


def _stars(classes: DataFrame, p: SketchParams) -> DataFrame:
    """Distinct pairs (a, b): each member of a bucket with the least member of its part of the bucket, and these with the
    least of the whole bucket. There are as many parts (by id hash) as the root of all classes, so that no task gets more
    than about that root of one bucket in either step."""
    parts = max(1, math.isqrt(classes.count()))
    banded = classes.select(F.explode("keys").alias("key"), "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)))
    led = banded.withColumn("lead", F.min("rep").over(Window.partitionBy("key", "part")))
    inner = led.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    heads = led.where("rep = lead").select("key", "rep").withColumn("lead", F.min("rep").over(Window.partitionBy("key")))
    return inner.union(heads.where("rep <> lead").select("rep", "lead")).distinct()


def _block_pairs(keys: np.ndarray, bands: np.ndarray, reps: np.ndarray, comps: np.ndarray, sizes: np.ndarray, is_row: np.ndarray, is_col: np.ndarray, outside: np.ndarray, sketch: np.ndarray, fine: np.ndarray, p: SketchParams, best: bool):
    """Pairs of a row and a column of different components within equal keys (sorted) whose estimates are in reach of the
    threshold; with ``best`` only the likeliest column of each row. A pair that meets in several bands is taken in the first."""
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    least = p.percent / 100 - p.slack
    alike = (p.percent / 100 - p.fine_slack) * (p.registers + p.fine)  # registers that a pair must share
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x, y, n, comp = sketch[lo:hi], fine[lo:hi], sizes[lo:hi].astype(float), comps[lo:hi]
        rest, all_cols = np.flatnonzero(is_row[lo:hi]), np.flatnonzero(is_col[lo:hi])
        for i0 in range(0, len(rest), 32):
            rows = rest[i0 : i0 + 32]
            for j0 in range(0, len(all_cols), 4096):
                cols = all_cols[j0 : j0 + 4096]
                apart = comp[rows][:, None] != comp[cols][None, :]
                if not best:  # two members outside the largest component meet as row and column twice
                    apart &= ~outside[lo + cols][None, :] | (reps[lo + rows][:, None] > reps[lo + cols][None, :])
                apart &= 100 * np.minimum(n[rows][:, None], n[cols]) >= p.percent * np.maximum(n[rows][:, None], n[cols])
                i, j = np.nonzero(apart)
                equal = (x[rows[i]] == x[cols[j]]).sum(1)
                near = equal >= (least - 0.05) * p.registers  # the other estimates only where this leaves them open
                i, j, equal = i[near], j[near], equal[near]
                near = equal + (y[rows[i]] == y[cols[j]]).sum(1) >= alike
                i, j = i[near], j[near]
                shared = (x[rows[i]] == x[cols[j]]).reshape(len(i), p.bands, p.rows).all(2)
                near = shared.argmax(1) == bands[lo]
                i, j = i[near], j[near]
                if not len(i):
                    continue
                a, b = rows[i], cols[j]
                e = estimate(x[a], x[b], n[a], n[b], p.base)
                keep = e >= least
                if best:
                    order = np.lexsort((-e, a))
                    first = np.ones(len(order), bool)
                    first[1:] = a[order][1:] != a[order][:-1]
                    chosen = np.zeros(len(a), bool)
                    chosen[order[first]] = True
                    keep &= chosen
                yield np.maximum(reps[lo + a[keep]], reps[lo + b[keep]]), np.minimum(reps[lo + a[keep]], reps[lo + b[keep]])


def _blocks(named: DataFrame, p: SketchParams) -> DataFrame:
    """rep and its blocks (array of key, band, is_row, is_col, outside) in the buckets with members of different components.

    The members outside a bucket's largest component (two members of that need no link) are its rows, all members its
    columns. They are dealt by id hash to parts of about ``block``; a block is one part of the rows against one of the columns.
    A bucket whose members are nearly all linked so costs rows in proportion to its size."""
    light = named.select(F.posexplode("keys").alias("band", "key"), "rep", "comp")
    many = light.groupBy("key", "comp").agg(F.count("*").alias("many"))  # summed before the shuffle, as the next
    whole = many.groupBy("key").agg(F.count("*").alias("comps"), F.sum("many").alias("all"), F.max(F.struct("many", "comp")).alias("top"))
    parts = lambda x: F.greatest(F.ceil(x / F.lit(p.block)).cast("int"), F.lit(1))
    mixed = whole.where("comps > 1").select("key", F.col("top.comp").alias("top"), parts(F.col("all") - F.col("top.many")).alias("down"), parts(F.col("all")).alias("over"))
    met = light.join(mixed, "key").withColumns({"outside": F.col("comp") != F.col("top"), "r": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("down")).cast("int"), "c": F.pmod(F.xxhash64("rep", F.lit(2)), F.col("over")).cast("int")})
    block = lambda i, j, row, col: F.struct(F.when((F.col("down") == 1) & (F.col("over") == 1), F.col("key")).otherwise(F.xxhash64("key", i, j)).alias("key"), F.col("band"), row.alias("is_row"), col.alias("is_col"), F.col("outside"))
    as_row = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("over") - 1), lambda j: block(F.col("r"), j, F.lit(True), j == F.col("c"))))
    others = F.filter(F.sequence(F.lit(0), F.col("down") - 1), lambda i: ~F.col("outside") | (i != F.col("r")))
    as_col = F.transform(others, lambda i: block(i, F.col("c"), F.lit(False), F.lit(True)))
    placed = met.select("rep", F.concat(F.coalesce(as_row, F.filter(as_col, lambda _: F.lit(False))), as_col).alias("at"))
    return placed.groupBy("rep").agg(F.flatten(F.collect_list("at")).alias("at"))  # at most one key of each band


def _across(candidates: DataFrame, comps: DataFrame, p: SketchParams, best: bool) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, lie in different components and may be similar enough."""
    named = candidates.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    shown = named.join(_blocks(named, p), "rep").select(F.explode("at").alias("at"), "rep", "comp", "n", "regs", "fine")
    banded = shown.select("at.key", "at.band", "rep", "comp", "n", "at.is_row", "at.is_col", "at.outside", "regs", "fine").repartition("key")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table):
            c = {name: t.column(name).combine_chunks() for name in t.schema.names}
            sketch, fine = (np.frombuffer(b"".join(c[x].to_pylist()), kind).reshape(t.num_rows, -1) for x, kind in (("regs", np.uint16), ("fine", np.uint8)))
            got = list(_block_pairs(*(c[x].to_numpy(zero_copy_only=False) for x in ("key", "band", "rep", "comp", "n", "is_row", "is_col", "outside")), sketch, fine, p, best))
            if got:
                a, b = (np.concatenate(x) for x in zip(*got, strict=True))
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield textscan.batch(a=pairs[0], b=pairs[1])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key[::-1] != key[-1], True)) if key[0] != key[-1] else len(key)
            cut = len(key) - last  # rows from here on belong to a bucket that may go on
            if cut or (held and held[-1].column(0)[0].as_py() != key[0]):
                if cut == 0:
                    yield from flush(pa.Table.from_batches(held))
                    held = [batch]
                else:
                    yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return banded.sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def linked_rows(rows: DataFrame, scratch: runtime.Scratch, p: SketchParams = SketchParams()) -> DataFrame:
    """rows: row (unique), text. One line per row: row, n_shingles, component (the smallest row reachable over links)."""
    spark = runtime.prepare(rows.sparkSession)
    docs = rows.select(F.col("row").alias("doc_id"), "text")
    sketched = scratch.write(sketch_documents(docs, p), "sketches")
    same = ["n", "s1", "s2"]
    classes = sketched.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("regs").alias("regs"), F.first("keys").alias("keys"))
    classes = scratch.write(classes, "classes")
    star = scratch.write(_stars(classes, p), "star")
    met = star.select(F.col("a").alias("rep")).union(star.select("b")).groupBy("rep").agg(F.count("*").alias("times"))
    # a comparison makes the optimiser see a selective side, and so sift texts by a Bloom filter (of bounded size) before the shuffle
    ids = scratch.write(met, "met").where("times >= 1").select("rep")
    with runtime.bloom_filters(spark):
        texts = scratch.write(_fine_texts(docs.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), p), "texts")
        fine = texts.select(F.col("doc_id").alias("rep"), "fine")
        candidates = scratch.write(classes.join(ids, "rep", "left_semi").join(fine, "rep").select("rep", "n", "regs", "keys", "fine"), "candidates")
    texts = texts.select("doc_id", "text")

    edges = scratch.write(_verified(_likely(star, candidates, p), texts, p), "edges-0")
    scratch.drop("star", "met")
    comps = components(edges, scratch, "cc0")
    for turn, best in ((1, True), (2, False)):
        pairs = _across(candidates, comps, p, best)
        more = scratch.write(_verified(pairs, texts, p), f"edges-{turn}")
        if more.take(1):
            edges = edges.union(more)
            comps = components(edges, scratch, f"cc{turn}")
    scratch.drop("texts", "candidates")
    final = classes.select(*same, "copies", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(*same, "copies", F.coalesce("comp", "rep").alias("comp"))
    named = runtime.join_hot(sketched.select("doc_id", *same), final, same, "copies", sketched.count(), F.xxhash64("doc_id"))
    out = scratch.write(named.select(F.col("doc_id").alias("row"), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component")), "linked")
    scratch.keep("linked", "rows")
    return out


def near_duplicates(docs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    scratch = runtime.Scratch(runtime.prepare(docs.sparkSession))
    rows, unique = runtime.row_keys(docs.select("doc_id", "text"), scratch)
    linked = linked_rows(rows, scratch, p)
    if unique:
        linked = linked.withColumns({"doc_id": F.col("row"), "component_id": F.col("component")})
    else:
        linked = linked.join(rows.select("row", "doc_id"), "row")
        names = linked.groupBy("component").agg(F.count("*").alias("rows"), F.min("doc_id").alias("component_id"))
        linked = runtime.join_hot(linked, names, ["component"], "rows", linked.count(), F.xxhash64("row"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return linked.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
