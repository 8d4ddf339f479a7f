"""Equity curves and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.normalize import ratio


def daily_equity(profits: DataFrame, start: float = 10_000.0) -> DataFrame:
    """profits: day, key, pnl. Equity at the end of each day with a profit, drawdown from the running peak."""
    w = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = profits.groupBy("key", "day").agg(F.sum("pnl").alias("pnl")).withColumn("equity", start + F.sum("pnl").over(w))
    d = d.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(start)))
    prev = F.coalesce(F.lag("equity").over(Window.partitionBy("key").orderBy("day")), F.lit(start))
    return d.withColumns({"drawdown": ratio(F.col("peak") - F.col("equity"), F.col("peak")), "ret": ratio(F.col("equity"), prev) - 1})


def every_day(equity: DataFrame) -> DataFrame:
    """key, day, equity for every day from a key's first to its last; days without a row keep the last equity."""
    days = equity.groupBy("key").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    filled = F.last("equity", ignorenulls=True).over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(equity.select("key", "day", "equity"), ["key", "day"], "left").withColumn("equity", filled)


def metrics(equity: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Of each key's equity (key, day, equity, pnl) by calendar day: Sharpe and Sortino (over the sample deviation of the losing days) a year of
    365 days, largest drop from the running peak as a share, yearly growth from ``start``, Calmar, profit factor and expectancy of the days with a row.
    Sortino is null without spread among losing days; growth needs two days, Calmar also a drop."""
    by = Window.partitionBy("key").orderBy("day")
    d = every_day(equity).withColumns({"prev": F.lag("equity").over(by), "peak": F.max("equity").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumns({"ret": ratio(F.col("equity"), F.col("prev")) - 1, "drop": ratio(F.col("peak") - F.col("equity"), F.col("peak"))})
    g = d.groupBy("key").agg(
        (F.max("day") - F.min("day")).alias("days"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"),
        F.max("drop").alias("max_drawdown"), F.max_by("equity", "day").alias("last"),
    )
    p = equity.groupBy("key").agg(F.sum(F.greatest("pnl", F.lit(0.0))).alias("won"), F.sum(F.least("pnl", F.lit(0.0))).alias("lost"), F.avg("pnl").alias("expectancy"))
    growth = F.when(F.col("days") > 0, F.pow(F.greatest(F.col("last") / start, F.lit(0.0)), 365.0 / F.col("days")) - 1)
    g = g.join(p, "key").withColumn("cagr", growth)
    root = 365.0**0.5
    return g.select(
        "key", "days", (root * ratio(F.col("mean"), F.col("sd"))).alias("sharpe"), (root * ratio(F.col("mean"), F.col("down"))).alias("sortino"), ratio(F.col("cagr"), F.col("max_drawdown")).alias("calmar"),
        "cagr", "max_drawdown", ratio(F.col("won"), -F.col("lost")).alias("profit_factor"), "expectancy",
    )


def longest_underwater(equity: DataFrame) -> DataFrame:
    """Most consecutive days below an earlier peak, per key: islands between days at the peak."""
    w = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    x = equity.withColumn("under", (F.col("equity") < F.col("peak")).cast("int")).withColumn("island", F.sum(1 - F.col("under")).over(w))
    runs = x.groupBy("key", "island").agg(F.sum("under").alias("run"))
    return runs.groupBy("key").agg(F.max("run").alias("longest"))


def halted(equity: DataFrame, limit: float) -> DataFrame:
    """First day at which the drawdown passes the limit."""
    return equity.where(F.col("drawdown") > limit).groupBy("key").agg(F.min("day").alias("halt_day"))


def folds(first: int, last: int, train: int, embargo: int, test: int) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) of a sliding walk, ends open."""
    out, at = [], first
    while at + train + embargo < last:
        out.append((at, at + train, at + train + embargo, min(last, at + train + embargo + test)))
        at += test
    return out


def walk_forward(rows: DataFrame, plan: list[tuple[int, int, int, int]]) -> DataFrame:
    """rows: day, value. Mean of each fold's training days and error of that mean on its test days; folds are exploded, a
    fixed number per row, and kept where the day falls in."""
    f = F.array(*(F.struct(F.lit(i).alias("fold"), *(F.lit(x).alias(n) for x, n in zip(p, ("a", "b", "c", "d"), strict=True))) for i, p in enumerate(plan)))
    x = rows.withColumn("f", F.explode(f)).select("day", "value", "f.*")
    part = F.when((F.col("day") >= F.col("a")) & (F.col("day") < F.col("b")), "train").when((F.col("day") >= F.col("c")) & (F.col("day") < F.col("d")), "test")
    x = x.withColumn("part", part).where("part is not null")
    g = x.groupBy("fold").agg(F.avg(F.when(F.col("part") == "train", F.col("value"))).alias("fitted"), F.avg(F.when(F.col("part") == "test", F.col("value"))).alias("seen"), F.count(F.when(F.col("part") == "test", 1)).alias("n_test"))
    return g.withColumn("error", F.col("seen") - F.col("fitted"))
