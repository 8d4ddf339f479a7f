"""Hidden Markov language model with Baum-Welch training on counts and exact scaled forward scoring.

Tokens are lower-cased words and one end token per text. Words are counted over all training texts. For the latent
part words fall into classes: the ``top_words`` most frequent words are classes of their own, the others share
``tail_classes`` by a hash of their last bytes, the end token is a class. A hidden state emits a class, the class emits
the word: P(word | state) = P(class | state) * P(word | class), with P(word | class) = (c + 0.5) / (C + 0.5 (V + 1)) from
the class's own counts C and types V, unknown words being one more type of their class. So texts have a proper
probability, log10 P(text) = log10 forward likelihood of the class sequence + sum of log10 P(word | class).

Training: expected counts of segments of ``segment`` tokens are computed in every task, summed by Spark, and
normalised on the driver (states x classes numbers, independent of the corpus). Every round uses all training texts. After
``first_rounds`` + ``full_rounds`` rounds they go on until the likelihood of a token gains less than ``least_gain`` (log10).

Word counts of unbounded vocabularies are never broadcast. One scan writes, for blocks of about ``block_bytes`` of text, the
distinct words of the block and each text as numbers of these; the counts are joined by word (a word is one row a block, so
none is hot) and come back to the block, where texts become class sequences. These are written, and all rounds and the
score read them; the texts are read once, so a plan that does not read the same way twice does no harm.

Words are told apart by 64-bit hashes. Null texts are empty: the end token alone. An empty training set leaves the uniform
model; an empty table gives no rows. Repeated rows and ids are scored, and learned from, row by row; rows whose ``training`` is null are not learned from.
Other columns are not read. A very long text is a block of its own, at about 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime, textscan

_U = np.uint64
END = 0


@dataclass(frozen=True)
class HmmParams:
    states: int = 8
    top_words: int = 2048
    tail_classes: int = 2048
    tail_bytes: int = 3
    segment: int = 256
    first_rounds: int = 8
    full_rounds: int = 2
    least_gain: float = 1e-3
    block_bytes: int = 8 << 20
    #: Tokens taken together in a round.
    together: int = 1 << 18
    #: Steps of the recursions between two scalings.
    scaling: int = 8
    smoothing: float = 0.1

    @property
    def classes(self) -> int:
        return 1 + self.tail_classes + self.top_words


@dataclass
class Model:
    start: np.ndarray
    again: np.ndarray  # of states at the first token of a later segment
    move: np.ndarray
    emit: np.ndarray  # classes x states


def tail_class(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: HmmParams) -> np.ndarray:
    """1 .. tail_classes by the last bytes of each word."""
    h = np.zeros(len(ends), np.uint64)
    for j in range(1, p.tail_bytes + 1):
        at = ends - j
        h = h * _U(263) + np.where(at >= starts, low[np.maximum(at, 0)].astype(_U) + _U(1), _U(0))
    return 1 + (textscan.mix(h) % _U(p.tail_classes)).astype(np.int64)


def random_start(frequency: np.ndarray, p: HmmParams) -> Model:
    rng = np.random.default_rng(11)
    emit = frequency[:, None] * np.exp(rng.normal(0, 1.0, (len(frequency), p.states)))
    move = np.full((p.states, p.states), 0.1 / max(1, p.states - 1))
    np.fill_diagonal(move, 0.9)
    if p.states == 1:
        move[:] = 1
    flat = np.full(p.states, 1 / p.states)
    return Model(flat, flat.copy(), move, emit / emit.sum(0))


def _in_step(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences sorted by falling size: how many are live at each step, and the place of each token, step by step."""
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    first = np.cumsum(live) - live
    row = np.arange(int(live.sum())) - np.repeat(first, live)
    return live, begin[row] + np.repeat(np.arange(len(live)), live)


def _forward(first: np.ndarray, e: np.ndarray, live: np.ndarray, move: np.ndarray, every: int) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Scaled forward recursion; e: emissions step by step, first: state probabilities of each sequence's first token. Forward
    values, divisors by step, and log10 likelihood of each sequence."""
    alpha, scales, fit = np.empty_like(e), {}, np.zeros(len(first))
    at = 0
    for t, k in enumerate(live.tolist()):
        a = alpha[at : at + k]
        if t:
            np.matmul(alpha[before : before + k], move, out=a)  # noqa: F821
        else:
            a[:] = first
        a *= e[at : at + k]
        on = live[t + 1] if t + 1 < len(live) else 0
        if t % every == every - 1:
            scales[t] = s = a.sum(1)
            a /= s[:, None]
            fit[:k] += np.log10(s)
        elif on < k:  # sequences that end here
            fit[on:k] += np.log10(a[on:].sum(1))
        before, at = at, at + k
    return alpha, scales, fit


def expected_counts(cls: np.ndarray, ptr: np.ndarray, model: Model, p: HmmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over segments: counts of starts, later-segment starts, moves and emissions; log10 likelihood and tokens."""
    s = p.states
    n = np.maximum(-(-np.diff(ptr) // p.segment), 0)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(ptr[:-1], n) + turn * p.segment
    size = np.minimum(p.segment, np.repeat(ptr[1:], n) - begin)
    by = np.argsort(-size, kind="stable")
    begin, size, row_first = begin[by], size[by], turn[by] == 0
    live, token = _in_step(begin, size)
    of = cls[token]
    e = np.take(model.emit, of, axis=0)
    alpha, scales, fit = _forward(np.where(row_first[:, None], model.start, model.again), e, live, model.move, p.scaling)
    start, again, move = np.zeros(s), np.zeros(s), np.zeros((s, s))
    gamma, beta = np.empty_like(e), np.ones((len(begin), s))
    at = len(e)
    back = np.ascontiguousarray(model.move.T)
    for t in range(len(live) - 1, -1, -1):
        k, on = int(live[t]), int(live[t + 1]) if t + 1 < len(live) else 0
        at -= k
        a, b = alpha[at : at + k], beta[:k]
        if on < k:
            b[on:] = 1 / a[on:].sum(1)[:, None]
        np.multiply(a, b, out=gamma[at : at + k])  # sums to 1: the values behind are scaled by the likelihood
        if t:
            ahead = b * e[at : at + k]
            if t in scales:
                ahead /= scales[t][:, None]
            move += alpha[at - live[t - 1] : at - live[t - 1] + k].T @ ahead
            np.matmul(ahead, back, out=b)
        else:
            start += gamma[:k][row_first].sum(0)
            again += gamma[:k][~row_first].sum(0)
    columns = np.ascontiguousarray(gamma.T)
    emit = np.stack([np.bincount(of, columns[i], p.classes) for i in range(s)], axis=1)
    return start, again, move * model.move, emit, np.array([fit.sum(), float(size.sum())])


def forward(cls: np.ndarray, ptr: np.ndarray, model: Model, every: int = 8) -> np.ndarray:
    """Exact log10 likelihood of each row's class sequence (none is empty) by the scaled forward recursion."""
    size = np.diff(ptr)
    by = np.argsort(-size, kind="stable")
    live, token = _in_step(ptr[:-1][by], size[by])
    out = np.empty(len(by))
    out[by] = _forward(np.broadcast_to(model.start, (len(by), len(model.start))), np.take(model.emit, cls[token], axis=0), live, model.move, every)[2]
    return out


def _sequences(batches, column: int, most: int):
    """Slices of the batches with about ``most`` tokens, with classes and row pointers."""
    for batch in batches:
        cls, ptr = textscan.unblob(batch.column(column), np.int16)
        lo = 0
        while lo < batch.num_rows:
            hi = min(max(int(np.searchsorted(ptr, ptr[lo] + most, "right")) - 1, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), cls[ptr[lo] : ptr[hi]].astype(np.int64), ptr[lo : hi + 1] - ptr[lo]
            lo = hi


def _round(learn: DataFrame, model: Model, p: HmmParams) -> tuple[Model, float]:
    """One Baum-Welch step over all rows of learn (cls), and the log10 likelihood of a token before it."""
    shared = learn.sparkSession.sparkContext.broadcast(model)
    s = p.states

    def count(batches):
        total = [np.zeros(s), np.zeros(s), np.zeros((s, s)), np.zeros((p.classes, s)), np.zeros(2)]
        for cls, ptr in _together(batches, p.together):
            for x, y in zip(total, expected_counts(cls, ptr, shared.value, p), strict=True):
                x += y
        flat = np.concatenate([x.ravel() for x in total])
        at = np.flatnonzero(flat)
        yield textscan.batch(at=at.astype(np.int32), v=flat[at])

    got = learn.select("cls").mapInArrow(count, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 * s + s * s + p.classes * s + 2)
    flat[got["at"].to_numpy(np.int64)] = got["v"].to_numpy()
    flat, fit = flat[:-2], flat[-2:]
    start, again, move, emit = flat[:s] + 1e-3, flat[s : 2 * s] + 1e-3, flat[2 * s : 2 * s + s * s].reshape(s, s) + 1e-3, flat[2 * s + s * s :].reshape(-1, s)
    share = emit.sum(1, keepdims=True) + 0.5
    emit = emit + p.smoothing * p.classes * share / share.sum()
    shared.unpersist()
    return Model(start / start.sum(), again / again.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), fit[0] / max(1.0, fit[1])


def _together(batches, most: int):
    """Classes and row pointers of all batches, in portions of about ``most`` tokens."""
    held, n = [], 0
    for _, cls, ptr in _sequences(batches, 0, most):
        held.append((cls, ptr))
        n += len(cls)
        if n >= most:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.concatenate([np.diff(ptr) for _, ptr in held])
    return np.concatenate([cls for cls, _ in held]), np.concatenate([[0], np.cumsum(sizes)])


def train(learn: DataFrame, model: Model, p: HmmParams) -> tuple[Model, list[float]]:
    """The model after all rounds, and the log10 likelihood of a token before each."""
    fits: list[float] = []
    while len(fits) < max(2, p.first_rounds + p.full_rounds) or fits[-1] - fits[-2] >= p.least_gain:
        model, fit = _round(learn, model, p)
        fits.append(fit)
    return model, fits


def score_texts(docs: DataFrame, training: Column, p: HmmParams = HmmParams()) -> DataFrame:
    """docs: doc_id, text. training: whether a row is learned from. Per row: doc_id, training, n_tokens, n_known,
    train_tokens, base_score (smoothed unigram) and score (the model), both log10 probabilities of the text."""
    spark = runtime.prepare(docs.sparkSession)
    scratch = runtime.Scratch(spark)
    docs = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))

    def number(batches):
        """A row for each text, with the places of its words among the block's; and a row for each word of the block: n (in training texts), tail."""
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            words, _, place = textscan.distinct(np.concatenate([x[2] for x in held]))
            n, tail = np.zeros(len(words), np.int64), np.empty(len(words), np.int16)
            at = 0
            for rows, learned, own, own_tail, index, ptr in held:
                to = place[at : at + len(own)]
                at += len(own)
                tail[to] = own_tail
                n[to] += np.bincount(index, np.repeat(learned, np.diff(ptr)), len(own)).astype(np.int64)  # words of a chunk are different
                yield _numbered(block, rows, texts=textscan.blobs(to[index].astype(np.int32), ptr))
            for lo in range(0, len(words), 1 << 16):
                yield _numbered(block, None, words=(np.arange(len(words), dtype=np.int32)[lo : lo + (1 << 16)], *(x[lo : lo + (1 << 16)] for x in (words.view(np.int64), n.astype(np.int32), tail))))

        for batch, data, offsets in textscan.chunks(batches):
            low = textscan.LOWER[data]
            starts, ends, ptr = textscan.words(low, offsets)
            words, first, index = textscan.distinct(textscan.range_hash(low, starts, ends))
            tail = tail_class(low, starts[first], ends[first], p).astype(np.int16)
            held.append(((batch.column(0), batch.column(2)), batch.column(2).to_numpy(zero_copy_only=False), words, tail, index.astype(np.int32), ptr))
            size += len(data)
            if size >= p.block_bytes:
                yield from flush()
                block, held, size = block + 1, [], 0
        if held:
            yield from flush()

    numbered = scratch.write(docs.mapInArrow(number, "block long, doc_id long, training boolean, place binary, at int, word long, n int, tail short"), "numbered")
    listed = numbered.where("word is not null").select("block", "at", "word", "n", "tail")
    counts = scratch.write(listed.groupBy("word").agg(F.sum("n").alias("c"), F.min("tail").alias("tail")).where("c > 0"), "counts")
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = docs.where("training").count()
    scratch.drop()  # the shuffle behind the counts goes before the next one begins
    n_all, n_types = n_words + n_ends, n_types + (n_ends > 0)

    frequent = counts.orderBy(F.desc("c"), "word").limit(p.top_words).select("word", "c").collect()
    is_top = spark.createDataFrame([(r["word"], 1 + p.tail_classes + i) for i, r in enumerate(frequent)], "word long, top int")  # at most top_words rows
    rest = counts.join(F.broadcast(is_top), "word", "left_anti").groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    scratch.drop()
    mass = np.full(p.classes, 0.5)  # C + 0.5 (V + 1) of each class
    for r in rest:
        mass[r["tail"]] += r["c"] + 0.5 * r["v"]
    alone = np.zeros(p.classes, bool)
    alone[END] = True
    alone[1 + p.tail_classes :] = True
    floor = np.log10(n_all + 0.5 * (n_types + 1)) if n_all else np.log10(0.5)

    found = listed.select("block", "at", "word", "tail").join(counts.select("word", "c"), "word", "left").join(F.broadcast(is_top), "word", "left")
    parts = max(1, listed.where("at = 0").count() // 4)  # blocks, by four
    known = found.select("block", "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("top", "tail").cast("short").alias("class")).repartition(parts, "block")
    given = scratch.read("numbered").where("place is not null").select("block", "doc_id", "training", "place").repartition(parts, "block")

    def rate(key, texts, vocabulary):
        """Class sequences, and the parts of the scores that need no model."""
        own = texts.combine_chunks()
        at = vocabulary.column("at").to_numpy()
        c, of = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        c[at], of[at] = vocabulary.column("c").to_numpy(), vocabulary.column("class").to_numpy()
        plain = np.log10(c + 0.5)
        inside = np.where(alone[of], 0.0, plain - np.log10(mass[of]))
        place, ptr = textscan.unblob(own.column("place").combine_chunks() if isinstance(own.column("place"), pa.ChunkedArray) else own.column("place"), np.int32)
        many = len(ptr) - 1
        row = np.repeat(np.arange(many), np.diff(ptr))
        sums = lambda x: np.bincount(row, x[place], many)
        tokens = np.diff(ptr) + 1
        cls = np.insert(of.astype(np.int16)[place], ptr[1:], END)
        return pa.table({
            "doc_id": own.column("doc_id"), "training": own.column("training"), "n_tokens": pa.array(tokens), "n_known": sums(c > 0).astype(np.int64) + (n_ends > 0),
            "base_score": sums(plain) + np.log10(n_ends + 0.5) - tokens * floor, "inside": sums(inside), "cls": textscan.blobs(cls, ptr + np.arange(len(ptr))),
        })

    result = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, inside double, cls binary"
    rated = scratch.write(given.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(rate, result), "sequences")
    scratch.keep("sequences")

    frequency = np.maximum(mass, 1.0)
    for i, r in enumerate(frequent):
        frequency[1 + p.tail_classes + i] = r["c"]
    frequency[END] = max(1, n_ends)
    model = random_start(frequency / frequency.sum(), p)
    if n_ends:
        model, _ = train(rated.where("training").select("cls"), model, p)
    final = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch, cls, ptr in _sequences(batches, 6, p.together):
            total = forward(cls, ptr, final.value, p.scaling) + batch.column(5).to_numpy()
            yield textscan.batch(doc_id=batch.column(0), training=batch.column(1), n_tokens=batch.column(2), n_known=batch.column(3), train_tokens=np.full(len(total), n_all), base_score=batch.column(4), score=total)

    return rated.mapInArrow(score, "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _numbered(block: int, rows, texts: pa.Array | None = None, words: tuple | None = None) -> pa.RecordBatch:
    """Rows of texts (doc_id and training in ``rows``), or of a block's words."""
    n = len(texts) if words is None else len(words[0])
    empty = lambda kind: pa.nulls(n, kind)
    doc_id, training = rows if rows is not None else (empty(pa.int64()), empty(pa.bool_()))
    at, word, count, tail = words if words is not None else map(empty, (pa.int32(), pa.int64(), pa.int32(), pa.int16()))
    return textscan.batch(block=np.full(n, block), doc_id=doc_id, training=training, place=empty(pa.binary()) if texts is None else texts, at=at, word=word, n=count, tail=tail)
