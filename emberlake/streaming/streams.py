"""Structured Streaming forms. Each takes a streaming (or batch) DataFrame of ticks with an event time ``at``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

LATE = "30 minutes"


def events_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files as they arrive; zone-less times become event times."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def once(df: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    return df.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def tumbling(df: DataFrame, size: str, *keys: str, late: str = LATE) -> DataFrame:
    g = df.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, size: str, slide: str, *keys: str, late: str = LATE) -> DataFrame:
    g = df.withWatermark("at", late).groupBy(F.window("at", size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str, *keys: str, late: str = LATE) -> DataFrame:
    g = df.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), *keys, "n", "total")


def decayed_weight(df: DataFrame, decay: float = 0.95, late: str = LATE) -> DataFrame:
    """Per user the weight after each micro-batch: decays per minute between events over a second apart, adds the value.
    State of users idle for a day is dropped. Events of one batch are taken in order of time and id."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        w, last, n = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(frames))
        rows = rows.assign(s=rows["at"].astype("datetime64[us]").astype("int64") // 1_000_000).sort_values(["s", "event_id"])
        for s, v in rows[["s", "value"]].itertuples(index=False):
            if last is not None and s - last > 1:
                w *= decay ** ((s - last) / 60)
            w, last, n = w + v, s, n + 1
        state.update((w, last, n))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs() + 1) + 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "weight": [w], "last_ts": [last], "n": [n]})

    x = df.withWatermark("at", late).select("event_id", "user_id", "value", "at")
    return x.groupBy("user_id").applyInPandasWithState(update, "user_id long, weight double, last_ts long, n long", "weight double, last_ts long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def with_late_metadata(trades: DataFrame, metadata: DataFrame, key: str, wait: str = LATE) -> DataFrame:
    """Trades wait for their metadata row (columns key, known_at) up to ``wait``, and go on without it after that."""
    t = trades.withWatermark("at", wait)
    m = metadata.withWatermark("known_at", wait).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col("known_at") <= F.col("at") + F.expr(f"interval {wait}")) & (F.col("known_at") >= F.col("at") - F.expr(f"interval {wait}"))
    return t.join(m, near, "leftOuter").drop("_key")


def order_books(messages: DataFrame) -> DataFrame:
    """Keyed state of an order book: per token its best bid and ask after each micro-batch. messages: seq, token, kind (book or delta), side, price (text or
    number), size, at. A run of snapshot rows replaces the book, deltas set levels, size 0 deletes, deltas before any snapshot are ignored. Messages of one batch
    are taken in order of seq; one with a seq not over the last seen is late and left out."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, in_snapshot, known, sides, prices, sizes = state.get if state.exists else (-1, False, False, [], [], [])
        book = dict(zip(zip(sides, prices, strict=True), sizes, strict=True))
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, kind, side, price, size in zip(rows["seq"].tolist(), rows["kind"], rows["side"], rows["price"].astype(float).tolist(), rows["size"].fillna(0.0).tolist(), strict=True):
            if seq <= last:
                continue
            last = seq
            if kind == "book" and not in_snapshot:
                book, known = {}, True
            in_snapshot = kind == "book"
            if known and size > 0:
                book[side, price] = size
            else:
                book.pop((side, price), None)
        levels = sorted(book)
        state.update((last, in_snapshot, known, [s for s, _ in levels], [p for _, p in levels], [book[x] for x in levels]))
        bids, asks = [p for s, p in levels if s == "bid"], [p for s, p in levels if s == "ask"]
        yield pd.DataFrame({"token": [key[0]], "seq": [last], "best_bid": [max(bids, default=None)], "best_ask": [min(asks, default=None)], "levels": [len(levels)]}).astype({"best_bid": "float64", "best_ask": "float64"})

    out = "token string, seq long, best_bid double, best_ask double, levels int"
    kept = "last long, in_snapshot boolean, known boolean, sides array<string>, prices array<double>, sizes array<double>"
    return messages.groupBy("token").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def idle_contracts(df: DataFrame, key: str, idle: str = "10 days", late: str = LATE) -> DataFrame:
    """Timers: a row (key, last event time in seconds, events) for each contract that was idle for ``idle`` of event time; its state goes, and it starts anew with its
    next event. df: key, at."""
    seconds = int(pd.Timedelta(idle).total_seconds())

    def update(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"key": [key_[0]], "last_ts": [last], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        at = pd.concat(list(frames))["at"].astype("datetime64[us]").astype("int64") // 1_000_000
        last, n = max(last, int(at.max())), n + len(at)
        state.update((last, n))
        state.setTimeoutTimestamp(max((last + seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    x = df.withWatermark("at", late).select(F.col(key).cast("string").alias("key"), "at")
    return x.groupBy("key").applyInPandasWithState(update, "key string, last_ts long, n long", "last_ts long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def with_dimension(df: DataFrame, load: Callable[[], DataFrame], key: str, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: joins each micro-batch with the dimension as it is at that batch (``load`` is called anew), and goes on with the joined rows, those
    without a match included."""

    def each(frame: DataFrame, batch_id: int) -> None:
        then(frame.join(load(), key, "left"), batch_id)

    return each


def in_block_order(logs: DataFrame, late: str = LATE) -> DataFrame:
    """Provider logs that come out of order and more than once: each (block, index) once, with event time ``at``; a window over blocks is final
    only when the watermark has passed it. Columns: at, block, index."""
    x = logs.withWatermark("at", late).dropDuplicatesWithinWatermark(["block", "index"])
    return x.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.min("block").alias("first_block"), F.max("block").alias("last_block")).select(F.unix_seconds("w.start").alias("start"), "n", "first_block", "last_block")


def legs(df: DataFrame) -> DataFrame:
    """Taker and maker row of each fill: id, wallet, side_mult, role. Stateless, so it streams as it is."""
    two = F.array(F.struct(F.col("taker").alias("wallet"), F.col("side_mult"), F.lit("taker").alias("role")), F.struct(F.col("maker").alias("wallet"), (-F.col("side_mult")).alias("side_mult"), F.lit("maker").alias("role")))
    return df.select("id", F.explode(two).alias("x")).select("id", "x.*")


def json_messages(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Fields of the messages of a socket or queue, which come as JSON text: objects, or arrays of objects. What is neither gives no row."""
    one, many = F.from_json(column, schema), F.from_json(column, f"array<struct<{_fields(schema)}>>")
    listed = F.when(F.ltrim(column).startswith("["), many).otherwise(F.array(one))
    x = raw.withColumn("_m", F.explode(listed)).where(F.col("_m").isNotNull())
    names = [f.name for f in StructType.fromDDL(schema)]
    return x.where(F.coalesce(*(F.col(f"_m.{n}").cast("string") for n in names)).isNotNull()).select(*(c for c in raw.columns if c != column), "_m.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", each: Callable | None = None) -> DataFrame | None:
    """Processes what is there and stops: into a memory table, or batch by batch through ``each(frame, batch_id)``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("memory").queryName(name)).start()
    q.awaitTermination()
    return None if each else df.sparkSession.table(name)
