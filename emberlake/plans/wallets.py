"""Queries on positions, leaderboards and wallet calibration."""

from pyspark.sql import functions as F

from emberlake.operators import fresh, positions
from emberlake.plans.registry import query, r6
from emberlake.plans.views import MARKETS, TRADES, markets, trades

_POS = f"""WITH {TRADES}, {MARKETS},
pos AS (
  SELECT wallet, contract_id, sum(CASE WHEN tokens > 0 THEN abs(tokens) ELSE 0e0 END) AS ql, sum(CASE WHEN tokens > 0 THEN price * abs(tokens) ELSE 0e0 END) AS cl,
         sum(CASE WHEN tokens > 0 THEN 0e0 ELSE abs(tokens) END) AS qs, sum(CASE WHEN tokens > 0 THEN 0e0 ELSE (1 - price) * abs(tokens) END) AS cs, count(*) AS n_trades, min(ts) AS first_ts
  FROM trades WHERE price BETWEEN 0 AND 1 GROUP BY ALL),
pnl AS (
  SELECT pos.*, resolved_at, outcome, cl + cs AS invested, ql * outcome + qs * (1 - outcome) - (cl + cs) AS pnl FROM pos JOIN markets USING (contract_id) WHERE outcome IS NOT NULL)"""
_OVER = "OVER (PARTITION BY wallet ORDER BY resolved_at, contract_id ROWS UNBOUNDED PRECEDING)"


def _pnl(spark, sf):
    return positions.with_pnl(positions.accumulate(trades(spark, sf)), markets(spark, sf))


@query(f"""{_POS}, bank AS (SELECT *, sum(invested) {_OVER} + sum(pnl) {_OVER} AS bank FROM pnl),
down AS (SELECT *, max(bank) {_OVER} - bank AS down FROM bank),
g AS (SELECT wallet, sum(pnl) AS pnl, sum(invested) AS invested, max(down) AS drawdown, sum(n_trades) AS n FROM down GROUP BY wallet)
SELECT wallet, round(pnl, 6) AS pnl, round(invested, 6) AS invested, round(drawdown, 6) AS drawdown, CAST(n AS BIGINT) AS n_trades,
       round(100 * pnl / nullif(invested, 0) + least(pnl / greatest(drawdown, 1e0), 5e0), 6) AS score FROM g WHERE n >= 2 AND invested > 10""")
def q01_leaderboard(spark, sf):
    g = positions.leaderboard(_pnl(spark, sf))
    return g.select("wallet", "n_trades", *r6(pnl="pnl", invested="invested", drawdown="drawdown", score="score"))


_CUM = f"""{_POS}, cum AS (SELECT *, sum(pnl) {_OVER} AS cum FROM pnl),
down AS (SELECT *, greatest(max(cum) {_OVER}, 0e0) - cum AS down FROM cum),
g AS (SELECT wallet, sum(pnl) AS pnl, sum(invested) AS invested, max(down) AS drawdown, sum(n_trades) AS n FROM down GROUP BY wallet)"""


def _gated(spark, sf):
    """Prices at the ends do not count in the earliest leaderboard."""
    return positions.with_pnl(positions.accumulate(trades(spark, sf), 0.001, 0.999), markets(spark, sf))


@query(f"{_CUM.replace('BETWEEN 0 AND 1', 'BETWEEN 0.001 AND 0.999')} SELECT wallet, round(pnl, 6) AS pnl, round(drawdown, 6) AS drawdown, round(100 * pnl / nullif(invested, 0) + pnl / (drawdown + 1e-6), 2) AS score FROM g WHERE n >= 2 AND invested > 10")
def q02_leaderboard_uncapped(spark, sf):
    return positions.leaderboard_uncapped(_gated(spark, sf)).select("wallet", *r6(pnl="pnl", drawdown="drawdown"), F.round("score", 2).alias("score"))


@query(f"{_CUM} SELECT wallet, round(least(5e0, pnl / (drawdown + 1e-6)) + pnl / nullif(invested, 0), 6) AS score FROM g WHERE n > 1 AND n >= 2 AND invested > 10")
def q02b_leaderboard_calmar(spark, sf):
    return positions.leaderboard_calmar(_pnl(spark, sf)).select("wallet", *r6(score="score"))


@query(f"""{_POS}, x AS (SELECT *, pnl / nullif(invested, 0) AS roi, greatest((resolved_at - first_ts) / 86400e0, 1e0) AS days FROM pnl WHERE invested > 0),
y AS (SELECT *, greatest(roi, -0.999999) * 365 / days AS irr, sum(pnl) {_OVER} + sum(invested) {_OVER} AS cum FROM x), z AS (SELECT *, max(cum) {_OVER} AS peak FROM y),
g AS (SELECT wallet, count(*) AS n, sum(invested) AS invested, sum(irr * invested) / nullif(sum(invested), 0) AS irr, max((peak - cum) / nullif(peak, 0)) AS drawdown, sqrt(avg(pow(least(roi, 0e0), 2))) AS downside FROM z GROUP BY wallet)
SELECT wallet, n, round(irr, 6) AS irr, round(irr / (((1 + drawdown) + (1 + downside)) / 2) / CASE WHEN n < 6 THEN 6 - n ELSE 1 END, 6) AS score FROM g WHERE invested > 100""")
def q03_leaderboard_annual(spark, sf):
    return positions.leaderboard_annual(_pnl(spark, sf)).select("wallet", "n", *r6(irr="irr", score="score"))


def _elite_sql(now: str, least_size: float, least_roi: float) -> str:
    return f"""{_POS}, x AS (SELECT *, floor(resolved_at / 86400) AS rd, floor(first_ts / 86400) AS fd, sum(pnl) {_OVER} AS cum FROM pnl WHERE invested > 0{now and f" AND floor(resolved_at / 86400) < {now}"}),
y AS (SELECT *, greatest(max(cum) {_OVER}, 0e0) - cum AS down, (pnl / invested) * (365e0 / greatest(1, rd + 1 - fd)) * invested AS weighted FROM x),
g AS (SELECT wallet, count(*) AS n, sum(invested) AS invested, sum(weighted) AS weighted, sum(pnl) AS pnl, max(down) AS drawdown, min(fd) AS fd, max(rd) AS rd FROM y GROUP BY wallet),
h AS (SELECT *, pnl * (365e0 / greatest(1, {now or "rd + 1"} - fd)) AS annual FROM g WHERE n >= 10 AND invested / n >= {least_size} AND weighted / invested >= {least_roi})
SELECT wallet, n, round(annual, 6) AS annual, round(annual / greatest(drawdown, greatest(100e0, 0.05 * invested)), 6) AS score FROM h
ORDER BY round(annual / greatest(drawdown, greatest(100e0, 0.05 * invested)), 9) DESC, wallet LIMIT 500"""


@query(_elite_sql("11631", 12, 0))  # the day of 1,005,000,000
def q04_elite(spark, sf):
    return positions.elite(_pnl(spark, sf), 1_005_000_000, least_size=12.0, least_roi=0.0).select("wallet", "n", *r6(annual="annual", score="score"))


@query(f"""WITH {TRADES}, {MARKETS} SELECT wallet, brand AS topic, count(*) AS n, round(avg(greatest(-1e0, least(3e0, CASE WHEN tokens > 0 THEN (outcome - price) / price ELSE (price - outcome) / greatest(1 - price, 0.01) END))), 6) AS roi
FROM trades JOIN markets USING (contract_id) WHERE outcome IS NOT NULL AND price BETWEEN 0.01 AND 0.99 GROUP BY ALL HAVING count(*) >= 3""")
def q05_wallet_roi(spark, sf):
    return positions.wallet_roi(trades(spark, sf), markets(spark, sf)).select("wallet", "topic", "n", *r6(roi="roi"))


@query(f"""WITH {TRADES}, {MARKETS} SELECT wallet, count(*) AS n, round(avg(pow(CASE WHEN tokens > 0 THEN 1e0 ELSE 0e0 END - outcome, 2)), 6) AS brier, round(avg(pow(price - outcome, 2)), 6) AS price_brier
FROM trades JOIN markets USING (contract_id) WHERE outcome IS NOT NULL GROUP BY wallet HAVING count(*) >= 3""")
def q06_wallet_brier(spark, sf):
    return positions.wallet_brier(trades(spark, sf), markets(spark, sf)).select("wallet", "n", *r6(brier="brier", price_brier="price_brier"))


@query(f"""WITH {TRADES}, {MARKETS}, x AS (SELECT wallet, CASE WHEN tokens > 0 THEN -usdc ELSE usdc END + tokens * outcome AS gain FROM trades JOIN markets USING (contract_id) WHERE outcome IS NOT NULL),
g AS (SELECT wallet, sum(gain) AS total, stddev_samp(gain) AS spread, count(*) AS n FROM x GROUP BY wallet)
SELECT wallet, n, round(total, 6) AS total, round(spread, 6) AS spread FROM g WHERE n >= 5 AND total > 50 AND total / nullif(spread, 0) > 0.25""")
def q07_wallet_quality(spark, sf):
    return positions.wallet_quality(trades(spark, sf), markets(spark, sf)).select("wallet", "n", *r6(total="total", spread="spread"))


@query(f"""WITH {TRADES}, {MARKETS}, b AS (SELECT wallet, avg(pow(CASE WHEN tokens > 0 THEN 1e0 ELSE 0e0 END - outcome, 2)) AS brier FROM trades JOIN markets USING (contract_id) WHERE outcome IS NOT NULL GROUP BY wallet HAVING count(*) >= 20),
x AS (SELECT contract_id, price, abs(usdc) / (coalesce(brier, 0.25) + 0.001) AS w FROM trades LEFT JOIN b USING (wallet))
SELECT contract_id, count(*) AS n, round(sum(price * w) / nullif(sum(w), 0), 6) AS smart_price FROM x GROUP BY contract_id""")
def q08_smart_price(spark, sf):
    t = trades(spark, sf)
    return positions.smart_price(t, positions.wallet_brier(t, markets(spark, sf), 20)).select("contract_id", "n", *r6(smart_price="smart_price"))


_FRESH = f"""WITH {TRADES}, {MARKETS}, t AS (SELECT *, tokens > 0 AS long FROM trades),
f AS (SELECT wallet, contract_id, long, ts AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts, order_id, contract_id, price, tokens) AS rn FROM t) WHERE rn = 1),
g AS (SELECT t.wallet, t.contract_id, t.long, f.first_ts, sum(CASE WHEN t.long THEN usdc ELSE abs(tokens) * (1 - price) END) AS risk, sum(abs(tokens)) AS qty, sum(price * abs(tokens)) / nullif(sum(abs(tokens)), 0) AS vwap
      FROM t JOIN f ON t.wallet = f.wallet AND t.contract_id = f.contract_id AND t.long = f.long GROUP BY ALL),
x AS (SELECT g.*, CASE WHEN long THEN outcome ELSE 1 - outcome END * qty / risk - 1 AS roi, ln(1 + risk) AS log_vol, CASE WHEN long THEN outcome > 0.5 ELSE outcome < 0.5 END AS won
      FROM g JOIN markets USING (contract_id) WHERE outcome IS NOT NULL AND risk > 0)"""


@query(f"{_FRESH} SELECT wallet, contract_id, long, round(risk, 6) AS risk, round(vwap, 6) AS vwap, round(roi, 6) AS roi, round(log_vol, 6) AS log_vol, won FROM x")
def q09_first_position(spark, sf):
    x = fresh.first_position(trades(spark, sf), markets(spark, sf))
    return x.select("wallet", "contract_id", "long", "won", *r6(risk="risk", vwap="vwap", roi="roi", log_vol="log_vol"))


@query(f"""{_FRESH} SELECT CASE WHEN risk <= 10 THEN 0 WHEN risk <= 50 THEN 1 WHEN risk <= 100 THEN 2 WHEN risk <= 250 THEN 3 WHEN risk <= 500 THEN 4 WHEN risk <= 1000 THEN 5 WHEN risk <= 5000 THEN 6 WHEN risk <= 10000 THEN 7 ELSE 8 END AS bin,
count(*) AS n, round(avg(won::INT::DOUBLE), 6) AS win_rate, round(avg(roi), 6) AS mean_roi, round(median(roi), 6) AS median_roi, round(avg(vwap), 6) AS mean_price FROM x GROUP BY 1""")
def q09b_fresh_buckets(spark, sf):
    g = fresh.buckets(fresh.first_position(trades(spark, sf), markets(spark, sf)))
    return g.select("bin", "n", *r6(win_rate="win_rate", mean_roi="mean_roi", median_roi="median_roi", mean_price="mean_price"))


@query(f"""{_FRESH}, s AS (SELECT count(*)::DOUBLE AS n, sum(log_vol) AS a, sum(vwap) AS b, sum(roi) AS y, sum(log_vol * log_vol) AS aa, sum(vwap * vwap) AS bb, sum(log_vol * vwap) AS ab, sum(log_vol * roi) AS ay, sum(vwap * roi) AS vy
  FROM x WHERE first_ts >= (SELECT max(first_ts) FROM x) - 3650 * 86400),
d AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s)
SELECT CAST(n AS BIGINT) AS n, round((y * (aa * bb - ab * ab) - a * (ay * bb - ab * vy) + b * (ay * ab - aa * vy)) / nullif(det, 0), 5) AS c0,
       round((n * (ay * bb - ab * vy) - y * (a * bb - ab * b) + b * (a * vy - ay * b)) / nullif(det, 0), 5) AS c1,
       round((n * (aa * vy - ay * ab) - a * (a * vy - ay * b) + y * (a * ab - aa * b)) / nullif(det, 0), 5) AS c2 FROM d WHERE n >= 50""")
def q10_fresh_ols(spark, sf):
    x = fresh.first_position(trades(spark, sf), markets(spark, sf))
    g = fresh.ols_two(fresh.last_year(x, 3650), "roi", "log_vol", "vwap").where("n >= 50")
    return g.select(F.col("n").cast("long").alias("n"), *(F.round(c, 5).alias(c) for c in ("c0", "c1", "c2")))


@query(f"""{_FRESH}, fit AS (SELECT regr_slope(roi, log_vol) AS s, regr_intercept(roi, log_vol) AS i, regr_count(roi, log_vol) AS n, regr_r2(roi, log_vol) AS r2 FROM x)
SELECT CAST(n AS BIGINT) AS n, round(r2, 6) AS r2, round(CASE WHEN s > 0 THEN s ELSE 0e0 END, 6) AS slope, round(CASE WHEN s > 0 THEN greatest(-0.1e0, least(0.1e0, i)) ELSE 0e0 END, 6) AS intercept FROM fit""")
def q11_fresh_linear(spark, sf):
    g = fresh.linear_gate(fresh.first_position(trades(spark, sf), markets(spark, sf)), "roi", "log_vol")
    return g.select("n", *r6(r2="r2", slope="slope", intercept="intercept"))


@query(f"""{_POS}, g AS (SELECT wallet, round(sum(pnl), 4) AS score FROM pnl GROUP BY wallet)
SELECT wallet, score, round(sign(score) * cume_dist() OVER (PARTITION BY sign(score) ORDER BY abs(score)), 6) AS percentile FROM g WHERE score <> 0""")
def q12_percentile(spark, sf):
    s = _pnl(spark, sf).groupBy("wallet").agg(F.round(F.sum("pnl"), 4).alias("score"))
    return positions.percentile(s).select("wallet", "score", *r6(percentile="percentile"))
