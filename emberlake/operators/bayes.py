"""Bayesian win-rate signal from wallets' own resolved histories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlake.functions.normalize import clamp
from emberlake.operators.windows import running_total

#: Half lives of the kernels and the reach beyond which a weight is dropped.
PRICE_HALF, TIME_HALF, PRICE_REACH = 25.0, 91.0, 100
TIME_REACH = math.floor(TIME_HALF * math.log2(100))
#: Buckets, of which a reach to both sides touches at most two.
_WIDE_PRICE, _WIDE_TIME = 2 * PRICE_REACH + 1, 2 * TIME_REACH + 1
#: Guard for truncation at whole numbers, whose logarithms differ in the last digit between engines.
EPS = 1e-9


def effective_yes(buy: Column, is_no: Column) -> Column:
    return buy != is_no


def pack(expected_p: Column, ttr_seconds: Column) -> dict[str, Column]:
    price = F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(1000 * expected_p + EPS))).cast("int")
    log = F.least(F.floor(1000 * F.log(F.greatest(F.lit(1.0), ttr_seconds / 3600.0)) + EPS), F.lit(2097151)).cast("int")
    return {"price_int": price, "log_ttr": log}


def packed_word(price_int: Column, log_ttr: Column, win: Column) -> Column:
    """price << 22 | log_ttr << 1 | win as one long."""
    return F.shiftleft(price_int.cast("long"), 22).bitwiseOR(F.shiftleft(log_ttr.cast("long"), 1)).bitwiseOR(win.cast("long"))


def _copies(trades: DataFrame) -> DataFrame:
    """Each trade for both sides and for each bucket that its reach touches."""
    sides = F.array(F.struct(F.col("yes").alias("h_yes"), F.col("price_int").alias("p"), F.lit(True).alias("own")), F.struct((~F.col("yes")).alias("h_yes"), (1000 - F.col("price_int")).alias("p"), F.lit(False).alias("own")))
    t = trades.withColumn("s", F.explode(sides)).select("id", "wallet", "log_ttr", "day", "s.*")
    cells = lambda c, reach, wide: F.explode(F.sequence(F.floor((c - reach) / wide), F.floor((c + reach) / wide)))
    return t.withColumn("slot", cells(F.col("p"), PRICE_REACH, _WIDE_PRICE)).withColumn("age", cells(F.col("log_ttr"), TIME_REACH, _WIDE_TIME))


def scan(trades: DataFrame, history: DataFrame) -> DataFrame:
    """Kernel sums of each trade over its wallet's history of the same and the opposite side.

    trades: id, wallet, yes, price_int, log_ttr, day. history: wallet, yes, price_int, log_ttr, win, day (of resolution).
    Only entries of earlier days count. Own side at p counts wins, the opposite side at 1 - p counts losses. Prices and times are
    bucketed by just over twice their reach, so each trade meets one to four buckets of its wallet's history, and is copied for these only.
    """
    h = history.select("wallet", F.col("yes").alias("h_yes"), F.col("price_int").alias("h_price"), F.col("log_ttr").alias("h_log"), "win", F.col("day").alias("h_day"), F.floor(F.col("price_int") / _WIDE_PRICE).alias("slot"), F.floor(F.col("log_ttr") / _WIDE_TIME).alias("age"))
    t = _copies(trades)
    dp, dl = F.abs(F.col("h_price") - F.col("p")), F.abs(F.col("h_log") - F.col("log_ttr"))
    j = t.join(h, ["wallet", "h_yes", "slot", "age"]).where((F.col("h_day") < F.col("day")) & (dp <= PRICE_REACH) & (dl <= TIME_REACH))
    w = F.pow(F.lit(0.5), dp / PRICE_HALF) * F.pow(F.lit(0.5), dl / TIME_HALF)
    hit = F.col("win") == F.col("own")
    return j.groupBy("id").agg(F.sum(w).alias("n"), F.sum(F.when(hit, w).otherwise(0.0)).alias("w"), F.count("*").alias("entries"))


def trust(brier_sum: Column, n: Column, stake: Column | None = None, price: Column | None = None, ttr_hours: Column | None = None, logit: list[float] | None = None) -> Column:
    """From the mean Brier score and its uncertainty. Wallets without history get the cold start: 1.33, or, with the four parameters of the
    first-bet model, up to 5 by how far the model is from the price."""
    cold = F.lit(1.33)
    if logit is not None and len(logit) == 4:
        odds = logit[0] + logit[1] * F.log1p(stake) + logit[2] * price + logit[3] * F.log1p(ttr_hours)
        cold = F.least(F.lit(5.0), 1 + 20 * F.abs(1 / (1 + F.exp(-odds)) - price))
    return F.when(n > 0, 1 / (F.least(F.lit(1.0), brier_sum / n + 0.5 / F.sqrt(n)) + 0.01)).otherwise(cold)


def posterior(p: Column, n: Column, w: Column, t: Column, variance: Column | None = None) -> dict[str, Column]:
    """Prior at the price with strength from the variance; evidence n, w scaled by trust."""
    flat = p * (1 - p)
    v = F.greatest(F.lit(1e-4), F.when(variance <= 0.35, variance).otherwise(flat) if variance is not None else flat)
    m = F.greatest(F.lit(1.0), flat / v - 1)
    prob = (w * t + m * p) / (n * t + m)
    return {"prob": prob, "variance": v, "margin": prob - p, "perc_margin": (prob - p) / F.nullif(p, F.lit(0.0))}


def resolve(positions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """History entries and Brier terms of positions whose contract is known: voids add no entry, and a Brier term only if confirmed."""
    x = positions.join(outcomes.select("contract_id", "outcome", "confirmed", "day"), "contract_id")
    void = F.abs(F.col("outcome") - 0.5) < 1e-9
    return x.select(
        "wallet", "contract_id", "yes", "price_int", "log_ttr", "day", F.when(~void, F.when(F.col("yes"), F.col("outcome") > 0.5).otherwise(F.col("outcome") < 0.5)).alias("win"),
        F.when(~void | F.col("confirmed"), F.pow(F.col("p_true") - F.col("outcome"), 2)).alias("brier"),
    )


def wager(trades: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """Fraction staked and implied probability of each trade; trades: id, ts, wallet, invest, price, yes; releases: ts, wallet, invest of
    positions that are settled (before the trades of the same second).

    A wallet's exposure is what it has put in and not got back; its peak is shrunk towards the mean peak of all wallets seen so far (the trade's own
    wallet counted, its peak left out), which depends on the total order of trades: increments of peaks and first trades are summed in that order by slices."""
    t = trades.select("id", "ts", "wallet", "invest", "price", "yes", F.lit(1).alias("kind"))
    if releases is not None:
        t = t.unionByName(releases.select("ts", "wallet", (-F.col("invest")).alias("invest"), F.lit(0).alias("kind")), allowMissingColumns=True)
    own = Window.partitionBy("wallet").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = t.withColumn("sum", F.sum("invest").over(own))
    # never below zero: as much as the sum has been below it so far is added back
    x = x.withColumn("exposure", F.col("sum") - F.least(F.lit(0.0), F.min("sum").over(own))).where("kind = 1")
    x = x.withColumns({"peak": F.max("exposure").over(own), "n": F.row_number().over(Window.partitionBy("wallet").orderBy("ts", "kind", "id"))})
    old = F.coalesce(F.lag("peak").over(Window.partitionBy("wallet").orderBy("ts", "kind", "id")), F.lit(0.0))
    x = x.withColumn("old", old).withColumns({"rise": F.col("peak") - F.col("old"), "first": (F.col("n") == 1).cast("int")})
    x = running_total(x, ["ts", "id"], {"all_peaks": "rise", "wallets": "first"})
    mean = (F.col("all_peaks") - F.col("rise") - F.col("old")) / F.col("wallets")
    shrunk = (F.col("n") * F.col("peak") + 5 * mean) / (F.col("n") + 5)
    f = F.least(F.lit(1.0), F.col("invest") / F.greatest("invest", "peak", shrunk))
    f = F.when(F.greatest("invest", "peak", shrunk) > 0, f).otherwise(0.0)
    p = F.col("price")
    return x.withColumn("fraction", f).withColumn("p_true", clamp(F.when(F.col("yes"), p + f * (1 - p)).otherwise(p - f * p), 0.001, 0.999)).select("id", "wallet", "fraction", "p_true")


def valid_variance_fit(a: Column, b: Column, c: Column) -> Column:
    """Whether a parabola a p^2 + b p + c can be a variance by price: not convex, tails over -0.02, middle in (0.001, 0.35]."""
    middle = a / 4 + b / 2 + c
    return F.coalesce((a <= 0) & (c >= -0.02) & (a + b + c >= -0.02) & (middle > 0.001) & (middle <= 0.35), F.lit(False))


def daily_delta(positions: DataFrame, markets: DataFrame, trades: DataFrame, now: int, since: int, idle_days: int = 10) -> DataFrame:
    """What a daily run does with each tracked contract and new trade: action, contract_id, rows.

    'resolve': its market has an outcome; 'purge': it has none and ended ``idle_days`` before ``now``, or is in no market; 'carry': the rest of the
    positions. 'ingest': trades after ``since`` within their market's life, priced in [0, 1]; times in seconds."""
    m = markets.select("contract_id", "outcome", "start", "end", F.lit(True).alias("known"))
    held = positions.groupBy("contract_id").agg(F.count("*").alias("rows")).join(m, "contract_id", "left")
    old = F.col("known").isNull() | F.coalesce(F.col("end") < now - 86400 * idle_days, F.lit(False))
    action = F.when(F.col("outcome").isNotNull() & ~F.isnan(F.col("outcome").cast("double")), "resolve").when(old, "purge").otherwise("carry")
    fresh = trades.where((F.col("ts") > since) & F.col("price").between(0, 1)).join(m, "contract_id").where(F.coalesce(F.col("ts") >= F.col("start"), F.lit(True)) & F.coalesce(F.col("ts") <= F.col("end"), F.lit(True)))
    new = fresh.groupBy("contract_id").agg(F.count("*").alias("rows")).withColumn("action", F.lit("ingest"))
    return held.select(action.alias("action"), "contract_id", "rows").unionByName(new.select("action", "contract_id", "rows"))


def orphans(positions: DataFrame, markets: DataFrame, now: int, idle_days: int = 10) -> DataFrame:
    """Contracts whose market ended ``idle_days`` before ``now``, or has no end and saw nothing (last_ts) since then."""
    cut = now - 86400 * idle_days
    gone = F.coalesce(F.col("end") < cut, F.lit(False)) | (F.col("end").isNull() & F.coalesce(F.col("last_ts") < cut, F.lit(False)))
    return positions.select("contract_id").distinct().join(markets.where(gone).select("contract_id"), "contract_id", "left_semi")
