"""Calibration of fresh wallets: first position, size bins, least squares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.normalize import ratio

#: Right-closed edges of the volume bins.
EDGES = (10, 50, 100, 250, 500, 1000, 5000, 10000)


def first_position(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """The first trade fixes contract and side of a wallet; later trades of both add up. risk: money in (long) or q (1-p)."""
    w = Window.partitionBy("wallet").orderBy("ts", "order_id", "contract_id", "price", "tokens")
    t = trades.withColumn("long", F.col("tokens") > 0)
    first = t.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("wallet", "contract_id", "long", F.col("ts").alias("first_ts"))
    q = F.abs("tokens")
    risk = F.when(F.col("long"), F.col("usdc")).otherwise(q * (1 - F.col("price")))
    g = t.join(first, ["wallet", "contract_id", "long"]).groupBy("wallet", "contract_id", "long", "first_ts").agg(F.sum(risk).alias("risk"), F.sum(q).alias("qty"), ratio(F.sum(F.col("price") * q), F.sum(q)).alias("vwap"))
    m = markets.where("outcome is not null").select("contract_id", "outcome")
    value = F.when(F.col("long"), F.col("outcome")).otherwise(1 - F.col("outcome")) * F.col("qty")
    x = g.join(m, "contract_id").where("risk > 0").withColumns({"roi": value / F.col("risk") - 1, "log_vol": F.log1p("risk")})
    return x.withColumn("won", F.when(F.col("long"), F.col("outcome") > 0.5).otherwise(F.col("outcome") < 0.5))


def update_first(state: DataFrame, trades: DataFrame) -> DataFrame:
    """First positions after more trades: state and result have wallet, contract_id, long, first_ts, risk, qty, cost (price times quantity), one row a wallet. Known wallets
    add what fits their contract and side, new ones start with their first trade; batches in order of time give what one run over all trades gives."""
    q, long = F.abs("tokens"), F.col("tokens") > 0
    risk = F.when(long, F.col("usdc")).otherwise(q * (1 - F.col("price")))
    t = trades.select("wallet", "contract_id", long.alias("long"), "ts", risk.alias("risk"), q.alias("qty"), (F.col("price") * q).alias("cost"), F.struct("ts", "order_id", "contract_id", "price", "tokens").alias("turn"))
    known = state.select("wallet", F.col("contract_id").alias("_c"), F.col("long").alias("_l"), F.col("first_ts").alias("_t"))
    first = t.groupBy("wallet").agg(F.min_by(F.struct("contract_id", "long", "ts"), "turn").alias("f"))
    of = first.join(known, "wallet", "left").select(
        "wallet", F.coalesce("_c", "f.contract_id").alias("contract_id"), F.coalesce("_l", "f.long").alias("long"), F.coalesce("_t", "f.ts").alias("first_ts"),
    )
    added = t.join(of, ["wallet", "contract_id", "long"]).groupBy("wallet", "contract_id", "long", "first_ts").agg(*(F.sum(c).alias(c) for c in ("risk", "qty", "cost")))
    both = state.select(*added.columns).unionByName(added)
    return both.groupBy("wallet", "contract_id", "long", "first_ts").agg(*(F.sum(c).alias(c) for c in ("risk", "qty", "cost")))


def volume_bin(risk: Column) -> Column:
    """0 .. 8 by right-closed edges; null at 0 and below."""
    chain = F.when(risk <= 0, F.lit(None).cast("int"))
    for i, e in enumerate(EDGES):
        chain = chain.when(risk <= e, i)
    return chain.otherwise(len(EDGES))


def buckets(positions: DataFrame) -> DataFrame:
    return positions.withColumn("bin", volume_bin(F.col("risk"))).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(F.col("won").cast("double")).alias("win_rate"), F.avg("roi").alias("mean_roi"), F.median("roi").alias("median_roi"), F.avg("vwap").alias("mean_price"),
    )


def ols_two(x: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """y ~ 1 + a + b from nine sums and Cramer's rule: one row, n, c0, c1, c2."""
    c = lambda n: F.col(n)
    s = x.agg(
        F.count("*").cast("double").alias("n"), F.sum(c(a)).alias("a"), F.sum(c(b)).alias("b"), F.sum(c(y)).alias("y"), F.sum(c(a) * c(a)).alias("aa"), F.sum(c(b) * c(b)).alias("bb"),
        F.sum(c(a) * c(b)).alias("ab"), F.sum(c(a) * c(y)).alias("ay"), F.sum(c(b) * c(y)).alias("by"),
    )
    det = lambda p, q, r: p[0] * (q[1] * r[2] - q[2] * r[1]) - q[0] * (p[1] * r[2] - p[2] * r[1]) + r[0] * (p[1] * q[2] - p[2] * q[1])
    one, ca, cb, cy = ([F.col(k) for k in ks] for ks in (("n", "a", "b"), ("a", "aa", "ab"), ("b", "ab", "bb"), ("y", "ay", "by")))
    d = det(one, ca, cb)
    return s.select("n", ratio(det(cy, ca, cb), d).alias("c0"), ratio(det(one, cy, cb), d).alias("c1"), ratio(det(one, ca, cy), d).alias("c2"))


def linear_gate(x: DataFrame, y: str, a: str, bound: float = 0.10) -> DataFrame:
    """Slope and intercept; kept only with a positive slope, intercept within +-bound."""
    g = x.agg(F.regr_slope(y, a).alias("slope"), F.regr_intercept(y, a).alias("intercept"), F.regr_count(y, a).alias("n"), F.regr_r2(y, a).alias("r2"))
    ok = F.col("slope") > 0
    return g.select("n", "r2", F.when(ok, F.col("slope")).otherwise(0.0).alias("slope"), F.when(ok, F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("intercept")))).otherwise(0.0).alias("intercept"))


def quadratic_fit(x: DataFrame, y: str, a: str, *keys: str) -> DataFrame:
    """Least squares parabola of y on a per key: c0 + c1 a + c2 a^2, by power sums."""
    sq = x.withColumn("_sq", F.col(a) * F.col(a))
    if not keys:
        return ols_two(sq, y, a, "_sq")
    c = lambda n: F.col(n)
    s = sq.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(c(a)).alias("a"), F.sum("_sq").alias("b"), F.sum(c(y)).alias("y"), F.sum("_sq").alias("aa"), F.sum(c("_sq") * c("_sq")).alias("bb"),
        F.sum(c(a) * c("_sq")).alias("ab"), F.sum(c(a) * c(y)).alias("ay"), F.sum(c("_sq") * c(y)).alias("by"),
    )
    det = lambda p, q, r: p[0] * (q[1] * r[2] - q[2] * r[1]) - q[0] * (p[1] * r[2] - p[2] * r[1]) + r[0] * (p[1] * q[2] - p[2] * q[1])
    one, ca, cb, cy = ([F.col(k) for k in ks] for ks in (("n", "a", "b"), ("a", "aa", "ab"), ("b", "ab", "bb"), ("y", "ay", "by")))
    d = det(one, ca, cb)
    return s.select(*keys, "n", ratio(det(cy, ca, cb), d).alias("c0"), ratio(det(one, cy, cb), d).alias("c1"), ratio(det(one, ca, cy), d).alias("c2"))


def last_year(positions: DataFrame, days: int = 365) -> DataFrame:
    """Positions first entered in the ``days`` up to the newest of them (one row joined, the positions are computed once)."""
    end = positions.agg(F.max("first_ts").alias("_end"))
    return positions.join(F.broadcast(end), F.col("first_ts") >= F.col("_end") - 86400 * days).drop("_end")


def first_bet(trades: DataFrame, markets: DataFrame, least_risk: float = 1.0) -> DataFrame:
    """Each wallet's earliest trade with over ``least_risk`` at risk in a settled contract: risk, log_vol, roi, won. trades: id, wallet,
    contract_id, price, tokens, usdc, ts; equal times go by id. Prices are cut to [0, 1], and to 1e-6 from the ends in the return."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("price")))
    long = F.col("tokens") > 0
    risk = F.when(long, F.col("usdc")).otherwise(F.abs("tokens") * (1 - p))
    x = trades.join(markets.where("outcome is not null").select("contract_id", "outcome"), "contract_id").withColumns({"risk": risk, "long": long}).where((F.col("risk") > least_risk) & F.col("ts").isNotNull())
    names = ["id", "contract_id", "price", "long", "risk", "outcome", "ts"]
    one = x.groupBy("wallet").agg(F.min_by(F.struct(*names), F.struct("ts", "id")).alias("x")).select("wallet", "x.*")
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("price")))
    o = F.col("outcome")
    roi = F.when(F.col("long"), (o - q) / q).otherwise((q - o) / (1 - q))
    return one.select("wallet", "id", "ts", "price", "risk", F.log1p("risk").alias("log_vol"), roi.alias("roi"), F.when(F.col("long"), o > 0.5).otherwise(o < 0.5).alias("won"))


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def line(x: DataFrame, y: str, a: str) -> dict[str, float]:
    """Slope, intercept, p-value of the slope, n: five sums come to the driver."""
    r = x.agg(F.regr_count(y, a).alias("n"), F.regr_slope(y, a).alias("slope"), F.regr_intercept(y, a).alias("intercept"), F.regr_r2(y, a).alias("r2")).first()
    n, r2 = r["n"], r["r2"]
    if not n or n < 3 or r["slope"] is None or r2 is None:
        return {"n": n or 0, "slope": 0.0, "intercept": 0.0, "p": 1.0}
    t = math.copysign(math.inf, r["slope"]) if r2 >= 1 else math.copysign(math.sqrt(r2 * (n - 2) / (1 - r2)), r["slope"])
    return {"n": n, "slope": r["slope"], "intercept": r["intercept"], "p": 0.0 if math.isinf(t) else t_tail(t, n - 2)}


def brier_line(trades: DataFrame, known: DataFrame | None = None, before: int | None = None, least: int = 50) -> tuple[float, float]:
    """Slope and intercept of the Brier score of unknown wallets' trades on log volume. trades: wallet, usdc, tokens, outcome, resolved_at; ``known``
    wallets are left out, and what resolves at or after ``before``. Nothing is made of fewer than ``least`` trades, of a slope over -0.002 or of a
    p-value of 0.2 and more: then 0 and 0.25. Else the slope is damped by its p-value, the intercept kept in [0.15, 0.35]."""
    x = trades.where("outcome is not null and usdc is not null and tokens is not null")
    if before is not None:
        x = x.where(F.col("resolved_at") < before)
    if known is not None:
        x = x.join(known.select("wallet").distinct(), "wallet", "left_anti")
    said = F.when(F.col("tokens") > 0, 1.0).otherwise(0.0)
    f = line(x.select(F.pow(said - F.col("outcome"), 2).alias("brier"), F.log1p("usdc").alias("log_vol")), "brier", "log_vol")
    if f["n"] < least or f["slope"] > -0.002 or f["p"] >= 0.2:
        return 0.0, 0.25
    return f["slope"] * (1 - f["p"] / 0.2), min(0.35, max(0.15, f["intercept"]))


def logit(rows: DataFrame, y: str, features: list[str], least: int = 50, rounds: int = 25) -> list[float] | None:
    """Maximum-likelihood logistic regression with an intercept, by Newton steps: each is one pass that sums gradient and curvature (a fixed number
    for each pair of features) over the rows. None with fewer than ``least`` rows, or where the curvature cannot be inverted."""
    import numpy as np

    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    k = len(x)
    beta = np.zeros(k)
    kept = rows.where(" and ".join(f"{c} is not null" for c in [y, *features]))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))))
        miss = F.col(y).cast("double") - p
        sums = [F.count("*"), *(F.sum(miss * c) for c in x), *(F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(k))]
        got = [v or 0.0 for v in kept.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()]
        if got[0] < least:
            return None
        try:
            step = np.linalg.solve(np.array(got[1 + k :], float).reshape(k, k), np.array(got[1 : 1 + k], float))
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta.tolist() if np.isfinite(beta).all() else None


def boosted(rows: DataFrame, y: str, features: list[str], **settings):
    """Gradient-boosted classifier: a fitted pyspark.ml model; its transform adds rawPrediction, probability and prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 7} | settings
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), GBTClassifier(labelCol=y, featuresCol="features", **chosen)]).fit(rows)


def calibrate(first_bets: DataFrame, variances: dict[str, DataFrame], now: int, days: int = 365, newest: int = 100_000) -> dict[str, list[float] | None]:
    """The models of a daily run: 'logit' of first bets (ts, log_vol, price, log_ttr, won) of the last ``days``, None under 50; and for each side of ``variances`` (ts, id, price,
    error) the parabola a, b, c of its ``newest`` rows, None under 1,000 rows or where it cannot be a variance."""
    recent = first_bets.where(F.col("ts") >= now - 86400 * days)
    out: dict[str, list[float] | None] = {"logit": logit(recent, "won", ["log_vol", "price", "log_ttr"])}
    for side, rows in variances.items():
        fit = quadratic_fit(rows.orderBy(F.desc("ts"), F.desc("id")).limit(newest), "error", "price").first()
        out[side] = None
        if fit["n"] >= 1000 and fit["c0"] is not None:
            a, b, c = fit["c2"], fit["c1"], fit["c0"]
            middle = a / 4 + b / 2 + c
            if a <= 0 and c >= -0.02 and a + b + c >= -0.02 and 0.001 < middle <= 0.35:
                out[side] = [a, b, c]
    return out
