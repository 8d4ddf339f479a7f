"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on the ``most_fitted`` vectors with the smallest id hashes (a documented bound); every vector is
then indexed by descending to a leaf. A query walks the tree through a priority queue ordered by what it may expect of a node:
the inner product with the centre, and the query's length times the node's spread times the reach of the largest of its rows, so
it meets leaves best first whatever the lengths of vectors. How many leaves are visited is calibrated: for ``calibration`` vectors the
true neighbours are found in blocks over all rows, and the visits are widened until their mean recall in those
neighbours reaches ``recall``; a query goes on where its leaves hold fewer candidates than it asks for.

Neighbouring leaves make up cells of about ``part_rows`` rows; larger leaves are cut into several cells by id hash, all of
which are visited, so a vector repeated in a third of all rows is no hot group. A query goes once to each cell of which it
visits leaves, with their list. Queries are dealt in parts of about ``query_part``, so that a task holds at most a
cell and a part of the queries. On vectors without structure calibration widens the visits to a fixed share of the leaves, and work grows with queries
times rows; the tree then saves only the leaves it leaves out.

Scores are inner products of the original vectors in double precision, summed in one fixed way, so equal vectors tie
exactly; ties go to the smaller id. Vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part, nor do rows without id. Of rows with equal id the least vector stands for all, so no id is found twice, nor by itself.
Fewer than ``top`` candidates give them all; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan


@dataclass(frozen=True)
class TreeParams:
    top: int = 20
    recall: float = 0.95
    branching: int = 8
    leaf_rows: int = 512
    most_fitted: int = 20_000
    #: Fitted vectors for each leaf, at least: with more than most_fitted / least_fitted * leaf_rows rows, leaves grow.
    least_fitted: int = 16
    calibration: int = 128
    part_rows: int = 4096
    query_part: int = 4096
    rounds: int = 8


class Tree:
    """centres: of all nodes; children: node to child nodes (leaves have none); leaf: number of each leaf node or -1;
    reach: of each node, what its rows' inner products with a unit vector may exceed the centre's by."""

    def __init__(self, centres: np.ndarray, children: list[list[int]], reach: np.ndarray):
        self.centres, self.children, self.reach = centres, children, reach
        self.leaf = np.full(len(children), -1)
        leaves = [i for i, c in enumerate(children) if not c]
        self.leaf[leaves] = np.arange(len(leaves))
        self.n_leaves = len(leaves)

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, branching: int, rounds: int) -> Tree:
        rng = np.random.default_rng(7)
        centres, children, todo = [x.mean(0) if len(x) else np.zeros(1)], [[]], [(0, np.arange(len(x)))]
        reach = [0.0]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            own = x[rows]
            c = own[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
            for _ in range(rounds):
                of = (own @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                n = np.bincount(of, minlength=len(c))
                sums = np.zeros_like(c)
                np.add.at(sums, of, own)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            of = (own @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            kept = [k for k in range(len(c)) if (of == k).any()]
            if len(kept) < 2:
                continue  # equal vectors cannot be split
            for k in kept:
                children[node].append(len(centres))
                todo.append((len(centres), rows[of == k]))
                own_rows = x[rows[of == k]]
                centres.append(own_rows.mean(0))
                spread = np.sqrt(((own_rows - centres[-1]) ** 2).sum(1).mean() / x.shape[1])
                reach.append(spread * np.sqrt(2 * np.log(len(own_rows) + 1)))
                children.append([])
        return cls(np.array(centres), children, np.array(reach))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every level."""
        node = np.zeros(len(x), np.int64)
        moving = np.arange(len(x)) if self.children[0] else np.zeros(0, np.int64)
        while len(moving):
            for parent in np.unique(node[moving]):
                own = moving[node[moving] == parent]
                kids = np.array(self.children[parent])
                c = self.centres[kids]
                node[own] = kids[(x[own] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
            moving = moving[[bool(self.children[i]) for i in node[moving]]]
        return self.leaf[node]

    def visits(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Up to ``most`` leaves, best bin first; more, where these hold fewer than ``least`` rows by ``sizes``."""
        scores = self.centres @ q + self.reach * np.sqrt(q @ q)
        queue, out = [(0.0, 0)], []
        rows = 0
        while queue and (len(out) < most or rows < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                rows += sizes.get(out[-1], 0) if sizes else 0
            for kid in self.children[node]:
                heapq.heappush(queue, (-float(scores[kid]), kid))
        return out


def dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, each summed alike wherever the row stands."""
    return (rows * q).sum(1)


def nearest(ids: np.ndarray, rows: np.ndarray, own: int, q: np.ndarray, top: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The top ids and exact scores for one query; rough: its inner products from a matrix product."""
    open_ = ids != own
    if open_.sum() > top:
        bar = np.partition(rough[open_], -top)[-top]
        open_ &= rough >= bar - 1e-9 * (1 + abs(bar))
    at = np.flatnonzero(open_)
    s = dots(rows[at], q)
    by = np.lexsort((ids[at], -s))[:top]
    return ids[at][by], s[by]


def nearest_many(ids: np.ndarray, rows: np.ndarray, own: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The top ids and exact scores of several queries, one after the other, and how many each has. A few more than the top
    are scored exactly; where more rows than that tie at the bar, the query is done by ``nearest``."""
    rough = q @ rows.T
    rough[ids[None, :] == own[:, None]] = -np.inf
    n, k = len(ids), min(len(ids), top + 12)
    at = np.argpartition(-rough, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), rough.shape)
    near = np.take_along_axis(rough, at, 1)
    exact = (rows[at] * q[:, None, :]).sum(-1)
    exact[np.isneginf(near)] = -np.inf
    by = np.lexsort((ids[at], -exact), axis=1)[:, :top]
    found, scores = np.take_along_axis(ids[at], by, 1), np.take_along_axis(exact, by, 1)
    crowded = np.zeros(len(q), bool)
    if n > k:
        bar = np.partition(near, k - top, axis=1)[:, k - top]
        crowded = (rough >= (bar - 1e-9 * (1 + np.abs(bar)))[:, None]).sum(1) > k
    out_ids, out_scores, sizes = [], [], []
    for i in range(len(q)):
        if crowded[i]:
            got, s = nearest(ids, rows, own[i], q[i], top, rough[i])
        else:
            ok = ~np.isneginf(scores[i])
            got, s = found[i][ok], scores[i][ok]
        out_ids.append(got)
        out_scores.append(s)
        sizes.append(len(got))
    return np.concatenate(out_ids), np.concatenate(out_scores), np.array(sizes)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, one for each id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(F.coalesce(finite & (F.size("v") > 0) & F.exists("v", lambda x: x != 0), F.lit(False)))
    if good.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").take(1):
        good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(vectors: DataFrame, queries: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """vectors, queries: vec_id, v as from ``usable``. query_id, rank, vec_id, score of each query's nearest found."""
    spark = runtime.prepare(vectors.sparkSession)
    scratch = runtime.Scratch(spark)
    n = vectors.count()
    by_hash = vectors.orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = np.array([r["v"] for r in by_hash.limit(p.most_fitted).select("v").toLocalIterator()], dtype=np.float64)
    leaves = min(p.most_fitted // p.least_fitted, max(1, n // p.leaf_rows))
    tree = Tree.fit(sample if len(sample) else np.zeros((0, 1)), max(2, len(sample) // leaves), p.branching, p.rounds)
    shared = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in batches:
            if b.num_rows:
                yield textscan.batch(vec_id=b.column(0), v=b.column(1), leaf=pa.array(shared.value.descend(_matrix(b.column(1))), pa.int32()))

    indexed = scratch.write(vectors.select("vec_id", "v").mapInArrow(index, "vec_id long, v array<double>, leaf int"), "indexed")
    width = _calibrated(indexed, shared, p) if n else 1

    sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most as many as leaves
    cells, at, room = {}, 0, p.part_rows  # first cell and number of cells of each leaf
    for leaf, size in sorted(sizes.items()):
        parts = -(-size // p.part_rows)
        if parts > 1 or size > room:
            at, room = at + 1, p.part_rows
        cells[leaf] = (at, parts)
        at, room = (at + parts, p.part_rows) if parts > 1 else (at, room - size)
    where = spark.sparkContext.broadcast((cells, sizes))

    def visit(batches):
        for b in batches:
            ids, flat = b.column(0).to_pylist(), _matrix(b.column(1)) if b.num_rows else ()
            out, cell, leaves = [], [], []
            for i, q in enumerate(flat):
                of: dict[int, list[int]] = {}
                cells, sizes = where.value
                for x in shared.value.visits(q, width, sizes, p.top + 1):
                    first, parts = cells.get(x, (0, 0))
                    for k in range(parts):
                        of.setdefault(first + k, []).append(x)
                for k, listed in of.items():
                    out.append(i)
                    cell.append(k)
                    leaves.append(listed)
            yield textscan.batch(query_id=pa.array([ids[i] for i in out], pa.int64()), q=b.column(1).take(pa.array(out, pa.int64())), cell=pa.array(cell, pa.int32()), leaves=pa.array(leaves, pa.list_(pa.int32())))

    placed = spark.createDataFrame([(leaf, first, parts) for leaf, (first, parts) in cells.items()], "leaf int, first int, parts int")  # one row a leaf
    query_parts = max(1, -(-queries.count() // p.query_part))
    rows = indexed.join(F.broadcast(placed), "leaf").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    rows = rows.select("vec_id", "v", "leaf", "cell", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("deal"))
    asked = queries.select("vec_id", "v").mapInArrow(visit, "query_id long, q array<double>, cell int, leaves array<int>")
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))

    def compare(key, left, right):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("leaf").combine_chunks(), right.combine_chunks()
            ids, x, leaf = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks()), left.column("leaf").to_numpy()
            q_ids, q = right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks())
            lists = right.column("leaves").combine_chunks()
            wanted = lists.flatten().to_numpy()
            asker = np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy())
            for k in np.unique(leaf):
                lo, hi = np.searchsorted(leaf, [k, k + 1])
                own = asker[wanted == k]
                for i in range(0, len(own), 256):
                    some = own[i : i + 256]
                    got, s, n = nearest_many(ids[lo:hi], x[lo:hi], q_ids[some], q[some], p.top)
                    out.append((np.repeat(some, n), got, s))
                if len(out) > 64:
                    out = [_best(*(np.concatenate(c) for c in zip(*out, strict=True)), p.top)]
        at, got, s = _best(*(np.concatenate(c) for c in zip(*out, strict=True)), p.top)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        bounds = pa.array(np.append(first, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (got, s)]
        return pa.table({"query_id": pa.array(q_ids[at[first]] if len(at) else np.zeros(0, np.int64)), "ids": lists[0], "scores": lists[1]})

    found = rows.groupBy("cell", "deal").cogroup(asked.groupBy("cell", "deal")).applyInArrow(compare, "query_id long, ids array<long>, scores array<double>")
    return _merge(found, p.top)


def _best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The top entries of each number in at, in order."""
    by = np.lexsort((ids, -scores, at))
    at, ids, scores = at[by], ids[by], scores[by]
    if not len(at):
        return at, ids, scores
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    keep = rank < top
    return at[keep], ids[keep], scores[keep]


def _merge(found: DataFrame, top: int) -> DataFrame:
    """The best of each query's partial lists: query_id, rank, vec_id, score."""
    zipped = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("cost"), i.alias("vec_id"), s.alias("score")))
    gathered = found.select("query_id", zipped.alias("near")).groupBy("query_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = gathered.select("query_id", F.posexplode(F.slice(F.array_sort("near"), 1, top)).alias("at", "x"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def brute_force(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, top: int) -> DataFrame:
    """Exact neighbours of a bounded set of query vectors: every task compares its rows with all of them."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def compare(batches):
        own, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in own]
        for b in batches:
            if not b.num_rows:
                continue
            known, x = b.column(0).to_numpy(), _matrix(b.column(1))
            rough = q @ x.T
            for i in range(len(own)):
                got, s = nearest(known, x, own[i], q[i], top, rough[i])
                got, s = np.append(best[i][0], got), np.append(best[i][1], s)
                by = np.lexsort((got, -s))[:top]
                best[i] = got[by], s[by]
        kept = [i for i in range(len(own)) if len(best[i][0])]
        yield textscan.batch(query_id=pa.array([int(own[i]) for i in kept], pa.int64()), ids=pa.array([best[i][0] for i in kept], pa.list_(pa.int64())), scores=pa.array([best[i][1] for i in kept], pa.list_(pa.float64())))

    return _merge(vectors.select("vec_id", "v").mapInArrow(compare, "query_id long, ids array<long>, scores array<double>"), top)


def _calibrated(indexed: DataFrame, shared, p: TreeParams) -> int:
    """Least number of leaf visits with enough mean recall over the calibration vectors."""
    chosen = indexed.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(p.calibration).collect()
    q = np.array([r["v"] for r in chosen])
    true = brute_force(indexed, np.array([r["vec_id"] for r in chosen]), q, p.top).join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    of: dict[int, list[int]] = {}
    for r in true:
        of.setdefault(r["query_id"], []).append(r["leaf"])
    tree = shared.value
    hits = np.zeros(tree.n_leaves)
    total = 0
    for r, v in zip(chosen, q, strict=True):
        turn = {leaf: i for i, leaf in enumerate(tree.visits(v, tree.n_leaves))}
        for leaf in of.get(r["vec_id"], ()):
            hits[turn[leaf]] += 1
            total += 1
    recall = np.cumsum(hits) / max(total, 1)
    return int(np.argmax(recall >= min(p.recall, recall[-1]))) + 1
