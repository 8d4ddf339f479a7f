"""Positions per wallet and contract, and the wallet leaderboards built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.normalize import clamp, ratio
from emberlake.operators.windows import running_total


def accumulate(trades: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Quantities and costs of the long and the short side of each wallet and contract; prices outside [low, high] are left out."""
    q, p, buy = F.abs("tokens"), F.col("price"), F.col("tokens") > 0
    return trades.where(p.between(low, high)).groupBy("wallet", "contract_id").agg(
        F.sum(F.when(buy, q).otherwise(0.0)).alias("qty_long"), F.sum(F.when(buy, p * q).otherwise(0.0)).alias("cost_long"),
        F.sum(F.when(buy, 0.0).otherwise(q)).alias("qty_short"), F.sum(F.when(buy, 0.0).otherwise((1 - p) * q)).alias("cost_short"),
        F.count("*").alias("n_trades"), F.min("ts").alias("first_ts"),
    )


def with_pnl(positions: DataFrame, markets: DataFrame) -> DataFrame:
    """invested and pnl of positions in resolved contracts."""
    m = markets.where("outcome is not null").select("contract_id", "outcome", "resolved_at", "kind")
    o = F.col("outcome")
    value = F.col("qty_long") * o + F.col("qty_short") * (1 - o)
    invested = F.col("cost_long") + F.col("cost_short")
    return positions.join(m, "contract_id").withColumns({"invested": invested, "pnl": value - invested})


def _running(column: Column, name: str, f=F.sum) -> Column:
    """In order of resolution; the contract breaks ties."""
    w = Window.partitionBy("wallet").orderBy("resolved_at", "contract_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return f(column).over(w).alias(name)


def leaderboard(pnl: DataFrame) -> DataFrame:
    """100 * roi plus capped profit per drawdown, for wallets with two trades and over 10 invested."""
    bank = pnl.withColumn("bank", _running(F.col("invested"), "i") + _running(F.col("pnl"), "p"))
    down = bank.withColumn("down", _running(F.col("bank"), "peak", F.max) - F.col("bank"))
    out = down.groupBy("wallet").agg(F.sum("pnl").alias("pnl"), F.sum("invested").alias("invested"), F.max("down").alias("drawdown"), F.sum("n_trades").alias("n_trades"))
    score = 100 * ratio(F.col("pnl"), F.col("invested")) + F.least(F.col("pnl") / F.greatest(F.col("drawdown"), F.lit(1.0)), F.lit(5.0))
    return out.where("n_trades >= 2 and invested > 10").withColumn("score", score)


def leaderboard_uncapped(pnl: DataFrame) -> DataFrame:
    """Earlier form: drawdown of cumulative profit from a peak of at least 0, no cap."""
    cum = pnl.withColumn("cum", _running(F.col("pnl"), "c"))
    down = cum.withColumn("down", F.greatest(_running(F.col("cum"), "peak", F.max), F.lit(0.0)) - F.col("cum"))
    out = down.groupBy("wallet").agg(F.sum("pnl").alias("pnl"), F.sum("invested").alias("invested"), F.max("down").alias("drawdown"), F.sum("n_trades").alias("n_trades"))
    return out.where("n_trades >= 2 and invested > 10").withColumn("score", 100 * ratio(F.col("pnl"), F.col("invested")) + F.col("pnl") / (F.col("drawdown") + 1e-6))


def leaderboard_calmar(pnl: DataFrame) -> DataFrame:
    """Profit per drawdown, capped at 5, plus roi."""
    base = leaderboard_uncapped(pnl)
    calmar = F.least(F.lit(5.0), F.col("pnl") / (F.col("drawdown") + 1e-6))
    return base.where("n_trades > 1").withColumn("score", calmar + ratio(F.col("pnl"), F.col("invested")))


def leaderboard_annual(pnl: DataFrame, least_invested: float = 100.0) -> DataFrame:
    """Investment-weighted annualised return over the mean of drawdown and downside risk; few positions are divided down."""
    days = F.greatest((F.col("resolved_at") - F.col("first_ts")) / 86400.0, F.lit(1.0))
    roi = ratio(F.col("pnl"), F.col("invested"))
    irr = F.greatest(roi, F.lit(-0.999999)) * 365 / days
    x = pnl.where("invested > 0").withColumns({"roi": roi, "irr": irr}).withColumn("cum", _running(F.col("pnl"), "c") + _running(F.col("invested"), "i"))
    x = x.withColumn("peak", _running(F.col("cum"), "k", F.max)).withColumn("down", ratio(F.col("peak") - F.col("cum"), F.col("peak")))
    out = x.groupBy("wallet").agg(
        F.count("*").alias("n"), F.sum("invested").alias("invested"), ratio(F.sum(F.col("irr") * F.col("invested")), F.sum("invested")).alias("irr"),
        F.max("down").alias("drawdown"), F.sqrt(F.avg(F.pow(F.least(F.col("roi"), F.lit(0.0)), 2))).alias("downside"),
    )
    score = F.col("irr") / (((1 + F.col("drawdown")) + (1 + F.col("downside"))) / 2)
    score = F.when(F.col("n") < 6, score / (6 - F.col("n"))).otherwise(score)
    return out.where(F.col("invested") > least_invested).withColumn("score", score)


def elite(pnl: DataFrame, as_of: int | None = None, top: int = 500, least_size: float = 100.0, least_roi: float = 0.5) -> DataFrame:
    """The ``top`` wallets by yearly profit per drawdown, of those with ten markets, a mean size of ``least_size`` and a yearly return
    of ``least_roi`` (each market's return a year, weighted by the money in it). Markets resolved before the day of ``as_of`` (seconds) count;
    profit is spread over the days since the wallet's first trade."""
    day = lambda c: F.floor(c / 86400)
    now = F.lit(as_of // 86400) if as_of is not None else None
    x = pnl.where(F.col("invested") > 0)
    if now is not None:
        x = x.where(day(F.col("resolved_at")) < now)
    held = F.greatest(F.lit(1), day(F.col("resolved_at")) + 1 - day(F.col("first_ts")))  # settled on the day after
    annual = (F.col("pnl") / F.col("invested")) * (365.0 / held)
    x = x.withColumns({"weighted": annual * F.col("invested"), "cum": _running(F.col("pnl"), "c")})
    x = x.withColumn("down", F.greatest(_running(F.col("cum"), "k", F.max), F.lit(0.0)) - F.col("cum"))
    g = x.groupBy("wallet").agg(
        F.count("*").alias("n"), F.sum("invested").alias("invested"), F.sum("weighted").alias("weighted"), F.sum("pnl").alias("pnl"), F.max("down").alias("drawdown"),
        F.min("first_ts").alias("first_seen"), F.max("resolved_at").alias("last"),
    )
    g = g.withColumns({"size": F.col("invested") / F.col("n"), "roi": F.col("weighted") / F.col("invested")}).where((F.col("n") >= 10) & (F.col("size") >= least_size) & (F.col("roi") >= least_roi))
    active = F.greatest(F.lit(1), (now if now is not None else day(F.col("last")) + 1) - day(F.col("first_seen")))
    g = g.withColumn("annual", F.col("pnl") * (365.0 / active))
    score = F.col("annual") / F.greatest(F.col("drawdown"), F.greatest(F.lit(100.0), 0.05 * F.col("invested")))
    return g.withColumn("score", score).orderBy(F.desc(F.round("score", 9)), "wallet").limit(top)


def wallet_roi(trades: DataFrame, markets: DataFrame, least: int = 3) -> DataFrame:
    """Mean clipped return by wallet and topic; the price of the short side is floored at 0.01."""
    p, o = F.col("price"), F.col("outcome")
    roi = F.when(F.col("tokens") > 0, (o - p) / p).otherwise((p - o) / F.greatest(1 - p, F.lit(0.01)))
    m = markets.where("outcome is not null").select("contract_id", "outcome", F.col("brand").alias("topic"))
    x = trades.where(p.between(0.01, 0.99)).join(m, "contract_id").withColumn("roi", clamp(roi, -1.0, 3.0))
    return x.groupBy("wallet", "topic").agg(F.avg("roi").alias("roi"), F.count("*").alias("n")).where(F.col("n") >= least)


def wallet_brier(trades: DataFrame, markets: DataFrame, least: int = 3) -> DataFrame:
    m = markets.where("outcome is not null").select("contract_id", "outcome")
    x = trades.join(m, "contract_id").withColumn("said", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0))
    return x.groupBy("wallet").agg(F.avg(F.pow(F.col("said") - F.col("outcome"), 2)).alias("brier"), F.avg(F.pow(F.col("price") - F.col("outcome"), 2)).alias("price_brier"), F.count("*").alias("n")).where(F.col("n") >= least)


def wallet_quality(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Realised profit: sum, spread, count; kept with five trades, over 50 in sum, and a sum over 0.25 of the spread. Both bounds are held to nine
    digits, so that a sum of just 50 is not over it in one order of its rows and under it in another."""
    m = markets.where("outcome is not null").select("contract_id", "outcome")
    gain = F.when(F.col("tokens") > 0, -F.col("usdc")).otherwise(F.col("usdc")) + F.col("tokens") * F.col("outcome")
    g = trades.join(m, "contract_id").groupBy("wallet").agg(F.sum(gain).alias("total"), F.stddev_samp(gain).alias("spread"), F.count("*").alias("n"))
    return g.where("n >= 5 and round(total, 9) > 50 and round(total / nullif(spread, 0e0), 9) > 0.25e0")


def smart_price(trades: DataFrame, scores: DataFrame, default: float = 0.25) -> DataFrame:
    """Mean price per contract, weighted by volume over the wallet's Brier score."""
    w = F.abs("usdc") / (F.coalesce("brier", F.lit(default)) + 0.001)
    x = trades.join(scores.select("wallet", "brier"), "wallet", "left").withColumn("w", w)
    return x.groupBy("contract_id").agg(ratio(F.sum(F.col("price") * F.col("w")), F.sum("w")).alias("smart_price"), F.count("*").alias("n"))


def percentile(scores: DataFrame) -> DataFrame:
    """Share of scores of the same sign that are not larger in size, with that sign: -1 to 1.

    Equal scores are counted first, and their running total goes by slices, so no task holds all scores of a sign."""
    x = scores.where("score <> 0").withColumns({"sign": F.signum("score"), "size": F.abs("score")})
    counts = x.groupBy("sign", "size").agg(F.count("*").alias("n"))
    out = None
    for sign in (1.0, -1.0):
        own = counts.where(F.col("sign") == sign)
        ranked = running_total(own, ["size"], {"upto": "n"}).withColumn("all", F.lit(own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        out = ranked if out is None else out.unionByName(ranked)
    share = out.select("sign", "size", (F.col("sign") * F.col("upto") / F.col("all")).alias("percentile"))
    return x.join(share, ["sign", "size"]).drop("sign", "size")
