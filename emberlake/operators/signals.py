"""Market signals from scored trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.normalize import clamp, normal_cdf, ratio
from emberlake.operators.windows import decayed_sum

#: What is left of a signal after a minute.
DECAY = 0.95


def running(ticks: DataFrame, key: str, order: tuple[str, ...] = ("ts", "id")) -> Window:
    del ticks
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def weight(ticks: DataFrame) -> DataFrame:
    """Sum of score * usdc * side per market over its volume so far. ticks: id, contract, ts, usdc, side, score; with a column
    is_yes, trades of No tokens count the other way."""
    w = running(ticks, "contract")
    side = F.col("side") * (F.when(F.col("is_yes"), 1).otherwise(-1) if "is_yes" in ticks.columns else F.lit(1))
    return ticks.select("id", "contract", ratio(F.sum(F.col("score") * F.col("usdc") * side).over(w), F.sum("usdc").over(w)).alias("signal"))


def decayed(ticks: DataFrame) -> DataFrame:
    """w decays by 0.95 a minute, gaps up to one second excepted, then adds usdc * (1 + min(2 ln(1 + 100 skill), 10)) * side.
    Trades under 1 and negative scores are skipped. One pass over each contract's ordered rows, with no horizon."""
    x = ticks.where("usdc >= 1 and score >= 0").withColumn("add", F.col("usdc") * (1 + F.least(2 * F.log(1 + 100 * F.col("score")), F.lit(10.0))) * F.col("side"))
    by = Window.partitionBy("contract").orderBy("ts", "id")
    gap = F.col("ts") - F.lag("ts").over(by)
    x = x.withColumn("gap", F.when(gap > 1, gap).otherwise(0)).withColumn("clock", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.select("id", "contract", "ts", "add", (F.col("clock") / 60.0).alias("clock"))
    return decayed_sum(x, "contract", ["ts", "id"], "clock", "add", DECAY, "signal").select("id", "contract", "signal")


def edge_normal(w: Column, price: Column, days: Column, threshold: float) -> Column:
    """p = 0.5 + (phi(w / (2 threshold)) - 0.5) e^(-0.01 days), in [0.01, 0.99], minus the price. phi: the normal distribution function."""
    phi = normal_cdf(w / (2 * threshold))
    return clamp(0.5 + (phi - 0.5) * F.exp(-0.01 * days), 0.01, 0.99) - price


def edge_trigger(edge: Column, price: Column, days: Column, least: float = 0.05) -> Column:
    """Whether an edge is acted on: the market still runs, the edge is large enough, and the price is not at an end."""
    return (days > 0) & (F.abs(edge) >= least) & price.between(0.02, 0.98)


def one_a_minute(triggers: DataFrame, key: str = "contract") -> DataFrame:
    """Of the rows (key, ts, id) the first of each key and minute."""
    w = Window.partitionBy(key, F.floor(F.col("ts") / 60)).orderBy("ts", "id")
    return triggers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def entry_signal(w: Column, splash: float) -> Column:
    return F.when(F.abs(w) > splash, "BUY").otherwise("NONE")


def smart_exit(position: Column, w: Column, splash: float, share: float) -> Column:
    """A long position is left when the signal is under splash * share, a short one when it is over the negative of that."""
    at = splash * share
    return F.coalesce(F.when(position == "YES", w < at).when(position == "NO", w > -at), F.lit(False))


def edge_tanh(w: Column, price: Column) -> Column:
    return 0.5 + 0.49 * F.tanh(w / 5000) - price


def roi_gate(price: Column, w: Column, days: Column, is_yes: Column, least: float = 5.0) -> Column:
    """Whether the return a year is over ``least``; the side bought is the token's for a positive signal, else the other. Markets at or past
    their end pass. Prices outside (0.05, 0.95) never do."""
    p = F.when((w > 0) == is_yes, price).otherwise(1 - price)
    annual = ((1 - p) / F.nullif(p, F.lit(0.0))) * (365.0 / F.nullif(days, F.lit(0.0)))
    return (price > 0.05) & (price < 0.95) & (F.coalesce(annual > least, F.lit(False)) | (days <= 0))


def fallback_score(volume: Column, slope: float, intercept: float, low: float = -0.10, high: float = 0.10) -> Column:
    """Of an unknown wallet, from its volume: a return within +-0.10, or a Brier score within [0.10, 0.35]."""
    return clamp(intercept + slope * F.log(F.greatest(volume, F.lit(1.0))), low, high)


def streaks(ticks: DataFrame, is_signal: Column) -> DataFrame:
    """Consecutive and cumulative count of signals per contract, reset by each row that is none."""
    w = running(ticks, "contract")
    x = ticks.withColumn("hit", F.coalesce(is_signal, F.lit(False)).cast("int")).withColumn("island", F.sum(1 - F.col("hit")).over(w)).withColumn("cumulative", F.sum("hit").over(w))
    inner = Window.partitionBy("contract", "island").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("streak", F.sum("hit").over(inner)).select("id", "contract", "streak", "cumulative")


def threshold_sweep(signals: DataFrame, thresholds: list[float], fresh_seconds: int | None = None) -> DataFrame:
    """Ten figures of the bets on each market's first row at or over each threshold (side 1), and at or under its negative (side -1, on No).

    signals: id, ts, market, signal, price, outcome, is_yes (of the token; others are turned to Yes), volume, started_at, resolved_at. With
    ``fresh_seconds`` only rows and markets of that last stretch count. Prices of Yes outside [0.05, 0.95] do not. A bet runs to the resolution, a day at least;
    its return a year is -1 if lost, else ((1 - p) / p) ** (1 / years) - 1, at most 6,570; won bets of 5 and less are left out, as are those without
    volume. The thresholds are exploded, a fixed number per row."""
    turn = lambda c: F.when(F.col("is_yes"), F.col(c)).otherwise(1 - F.col(c))
    x = signals.where("outcome is not null").withColumns({"price": turn("price"), "outcome": turn("outcome")})
    ends = signals.agg(F.max("ts").alias("_max"), F.min("ts").alias("_min"))  # one row
    x = x.join(F.broadcast(ends), F.lit(True)).withColumn("_from", F.col("_max") - fresh_seconds if fresh_seconds is not None else F.col("_min"))
    x = x.where((F.col("ts") >= F.col("_from")) & F.col("price").between(0.05, 0.95) & (F.col("started_at") >= F.col("_from"))).drop("_max", "_min", "_from")
    x = x.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("side", F.when(F.col("signal") > 0, 1).otherwise(-1)).where(F.abs("signal") >= F.col("threshold"))
    w = Window.partitionBy("threshold", "market", "side").orderBy("ts", "id")
    first = x.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    mirror = lambda c: F.when(F.col("side") > 0, F.col(c)).otherwise(1 - F.col(c))
    days = (F.col("resolved_at") - F.col("ts")) / 86400.0
    b = first.withColumns({"paid": mirror("price"), "won": mirror("outcome"), "days": days}).where("days > 0 and paid > 0 and volume > 0")
    rate = F.log((1 - F.col("paid")) / F.col("paid")) / F.greatest(F.col("days") / 365.25, F.lit(1 / 365.25))
    irr = F.when(F.col("won") != 1, -1.0).when(rate > math.log(6571), 6570.0).otherwise(F.exp(rate) - 1)
    b = b.withColumn("irr", irr).where("irr > 5 or won = 0")
    g = b.groupBy("threshold", "side").agg(
        F.avg("paid").alias("mean_price"), F.avg("irr").alias("mean_irr"), F.count("*").alias("bets"), F.count_if(F.col("won") == 1).alias("wins"), F.count_if(F.col("won") == 0).alias("losses"),
    )
    g = g.withColumn("win_rate", F.col("wins") / F.col("bets")).withColumn("margin", F.col("win_rate") - F.col("mean_price"))
    return g.withColumns({"win_loss": ratio(F.col("wins").cast("double"), F.col("losses")), "margin_share": F.col("margin") / F.col("mean_price"), "total": F.col("margin") * F.col("bets") / 100})


def stable_buckets(signals: DataFrame) -> DataFrame:
    """Rows with prob - price > 0.3 and variance < 0.15, in 5-cent buckets closed on the left."""
    x = signals.where("prob - price > 0.3 and variance < 0.15").withColumn("bucket", F.floor(F.round(F.col("price") * 100, 6) / 5).cast("int"))
    g = x.groupBy("bucket").agg(F.count("*").alias("bets"), F.count_distinct("market").alias("markets"), F.avg("price").alias("mean_price"), F.avg("outcome").alias("win_rate"))
    return g.withColumn("edge", F.col("win_rate") - F.col("mean_price"))


def life_price_grid(bets: DataFrame, most_price: float = 0.40, step: float = 0.05) -> DataFrame:
    """Life decile x price bucket with all totals, in one pass. bets: price, ts, start, end, outcome, pnl. Buckets are ``step`` wide
    up to ``most_price``, the last one takes what is over; decile 10 holds bets of markets of unknown or no life. margin tells
    the totals: 1 of all prices of a decile, 2 of all deciles of a price, 3 of everything."""
    last = round(most_price / step) - 1
    span = F.col("end") - F.col("start")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ts") - F.col("start")) / F.nullif(span, F.lit(0))))
    life = F.when(span > 0, F.least(F.floor(share * 10), F.lit(9))).otherwise(10).cast("int")
    x = bets.withColumns({"life": life, "bucket": F.least(F.floor(F.col("price") / step), F.lit(last)).cast("int")})
    g = x.cube("life", "bucket").agg(F.grouping_id().cast("int").alias("margin"), F.count("*").alias("n"), F.avg("outcome").alias("win_rate"), F.avg("price").alias("mean_price"), F.sum("pnl").alias("pnl"))
    return g.withColumn("edge", F.col("win_rate") - F.col("mean_price"))


def smart_exits(signals: DataFrame, entries: DataFrame, ratio_: float, threshold: float) -> DataFrame:
    """First row after entry at which the signal has moved by more than threshold * ratio from its entry value."""
    e = entries.select("contract", F.col("ts").alias("entry_ts"), F.col("signal").alias("entry_signal"))
    x = signals.join(e, "contract").where((F.col("ts") > F.col("entry_ts")) & (F.abs(F.col("signal") - F.col("entry_signal")) > threshold * ratio_))
    return x.groupBy("contract").agg(F.min_by(F.struct("id", "ts", "signal"), F.struct("ts", "id")).alias("x")).select("contract", "x.*")
