"""Queries on signals, Bayes, execution, performance and streams' batch forms; ticks stand for ordered fills."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlake.operators import bayes, execution, features, fresh, performance, signals
from emberlake.plans.registry import query, r6
from emberlake.plans.views import TICKS, table, ticks

_W = f"WITH {TICKS}"
#: A wallet's skill in the stand-in data.
_SCORE = "((wallet % 11) / 100.0)::DOUBLE"


def _scored(spark, sf):
    return ticks(spark, sf).withColumn("score", ((F.col("wallet") % 11) / 100.0).cast("double"))


@query(f"""{_W} SELECT id, contract, round(sum({_SCORE} * usdc * side * CASE WHEN id % 5 <> 0 THEN 1 ELSE -1 END) OVER w / nullif(sum(usdc) OVER w, 0), 6) AS signal FROM ticks WINDOW w AS (PARTITION BY contract ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
def q13_signal_weight(spark, sf):
    return signals.weight(_scored(spark, sf).withColumn("is_yes", F.col("id") % 5 != 0)).select("id", "contract", *r6(signal="signal"))


@query(f"""{_W}, x AS (SELECT *, usdc * (1 + least(2 * ln(1 + 100 * {_SCORE}), 10e0)) * side AS add, row_number() OVER w AS n, ts - lag(ts) OVER w AS g FROM ticks WHERE usdc >= 1 WINDOW w AS (PARTITION BY contract ORDER BY ts, id)),
y AS (SELECT *, sum(CASE WHEN g > 1 THEN g ELSE 0 END) OVER (PARTITION BY contract ORDER BY n) AS clock FROM x)
SELECT a.id, a.contract, round(sum(b.add * pow(0.95e0, (a.clock - b.clock) / 60e0)), 4) AS signal FROM y a JOIN y b ON a.contract = b.contract AND b.n <= a.n GROUP BY ALL""")
def q14_signal_decay(spark, sf):
    return signals.decayed(_scored(spark, sf)).select("id", "contract", F.round("signal", 4).alias("signal"))


@query(f"""{_W}, x AS (SELECT *, (usdc > 200)::INT AS hit FROM ticks), y AS (SELECT *, sum(1 - hit) OVER w AS island, sum(hit) OVER w AS cumulative FROM x WINDOW w AS (PARTITION BY contract ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT id, contract, CAST(sum(hit) OVER (PARTITION BY contract, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak, CAST(cumulative AS BIGINT) AS cumulative FROM y""")
def q15_q16_streaks(spark, sf):
    return signals.streaks(ticks(spark, sf), F.col("usdc") > 200)


def _sweep_rows(spark, sf):
    i, w, t = F.col("id"), F.col("wallet"), F.col("ts")
    return ticks(spark, sf).select(
        "id", "ts", w.alias("market"), (F.col("usdc") * F.col("side") / 100).alias("signal"), "price", (i % 2).cast("double").alias("outcome"), (i % 4 != 1).alias("is_yes"), F.when(i % 13 == 0, 0.0).otherwise(F.col("usdc")).alias("volume"),
        (F.lit(1704067200) + (w % 9) * 100000).alias("started_at"), (t + (w % 40 - 2) * 43200).alias("resolved_at"),
    )


_SWEEP = _W + f""", s AS (SELECT id, ts, wallet AS market, usdc * side / 100 AS signal, CASE WHEN id % 4 <> 1 THEN price ELSE 1 - price END AS price, CASE WHEN id % 4 <> 1 THEN (id % 2)::DOUBLE ELSE 1 - (id % 2)::DOUBLE END AS outcome,
 CASE WHEN id % 13 = 0 THEN 0e0 ELSE usdc END AS volume, 1704067200 + (wallet % 9) * 100000 AS st, ts + (wallet % 40 - 2) * 43200 AS en FROM ticks),
y AS (SELECT *, CASE WHEN signal > 0 THEN 1 ELSE -1 END AS side FROM s, (VALUES (0.5e0), (1e0), (2e0), (4e0)) t(threshold) WHERE ts >= (SELECT @@ FROM ticks) AND st >= (SELECT @@ FROM ticks) AND price BETWEEN 0.05 AND 0.95 AND abs(signal) >= threshold),
f AS (SELECT threshold, side, CASE WHEN side > 0 THEN price ELSE 1 - price END AS p, CASE WHEN side > 0 THEN outcome ELSE 1 - outcome END AS won, (en - ts) / 86400e0 AS days, volume FROM (SELECT *, row_number() OVER (PARTITION BY threshold, market, side ORDER BY ts, id) AS rn FROM y) WHERE rn = 1),
r AS (SELECT *, ln((1 - p) / p) / greatest(days / 365.25, 1 / 365.25) AS rate FROM f WHERE days > 0 AND p > 0 AND volume > 0), i AS (SELECT *, CASE WHEN won <> 1 THEN -1e0 WHEN rate > ln(6571) THEN 6570e0 ELSE exp(rate) - 1 END AS irr FROM r),
g AS (SELECT threshold, side, avg(p) AS mp, avg(irr) AS mi, count(*) AS bets, count(*) FILTER (won = 1) AS wins, count(*) FILTER (won = 0) AS losses FROM i WHERE irr > 5 OR won = 0 GROUP BY ALL)
SELECT threshold, side, bets, wins, losses, round(mp, 6) AS mean_price, round(mi, 4) AS mean_irr, round(wins / bets, 6) AS win_rate, round(wins / nullif(losses, 0), 6) AS win_loss, round(wins / bets - mp, 6) AS margin, round((wins / bets - mp) / mp, 6) AS margin_share,
 round((wins / bets - mp) * bets / 100, 6) AS total FROM g"""


def _sweep(spark, sf, fresh_seconds):
    g = signals.threshold_sweep(_sweep_rows(spark, sf), [0.5, 1.0, 2.0, 4.0], fresh_seconds)
    return g.select("threshold", "side", "bets", "wins", "losses", F.round("mean_irr", 4).alias("mean_irr"), *r6(**{c: c for c in ("mean_price", "win_rate", "win_loss", "margin", "margin_share", "total")}))


@query(_SWEEP.replace("@@", "min(ts)"))
def q17_threshold_sweep(spark, sf):
    return _sweep(spark, sf, None)


@query(_SWEEP.replace("@@", "max(ts) - 2000000"))
def q17b_fresh_sweep(spark, sf):
    """Of the last 2,000,000 seconds."""
    return _sweep(spark, sf, 2_000_000)


@query(f"""{_W}, x AS (SELECT wallet AS market, price, (id % 2)::DOUBLE AS outcome, ((id * 53) % 100) / 100e0 AS prob, ((id * 7) % 30) / 100e0 AS variance FROM ticks)
SELECT CAST(floor(round(price * 100, 6) / 5) AS INTEGER) AS bucket, count(*) AS bets, count(DISTINCT market) AS markets, round(avg(price), 6) AS mean_price, round(avg(outcome), 6) AS win_rate, round(avg(outcome) - avg(price), 6) AS edge
FROM x WHERE prob - price > 0.3 AND variance < 0.15 GROUP BY 1""")
def q18_stable_buckets(spark, sf):
    x = ticks(spark, sf).select(F.col("wallet").alias("market"), "price", (F.col("id") % 2).cast("double").alias("outcome"), (((F.col("id") * 53) % 100) / F.lit(100.0)).alias("prob"), (((F.col("id") * 7) % 30) / F.lit(100.0)).alias("variance"))
    return signals.stable_buckets(x).select("bucket", "bets", "markets", *r6(mean_price="mean_price", win_rate="win_rate", edge="edge"))


@query(f"""{_W}, b AS (SELECT *, ts - (id % 97) * 1000 AS st, CASE WHEN id % 11 <> 0 THEN ts + (id % 31) * 2000 - 10000 END AS en FROM ticks),
x AS (SELECT CASE WHEN en - st > 0 THEN CAST(least(floor(greatest(0e0, least(1e0, (ts - st) / nullif(en - st, 0))) * 10), 9) AS INTEGER) ELSE 10 END AS life, CAST(least(floor(price / 0.05::DOUBLE), 7) AS INTEGER) AS bucket, price, (id % 2)::DOUBLE AS outcome, usdc * side AS pnl FROM b)
SELECT life, bucket, CAST(GROUPING(life, bucket) AS INTEGER) AS margin, count(*) AS n, round(avg(outcome), 6) AS win_rate, round(avg(price), 6) AS mean_price, round(sum(pnl), 4) AS pnl, round(avg(outcome) - avg(price), 6) AS edge FROM x GROUP BY CUBE (life, bucket)""")
def q19_life_price_grid(spark, sf):
    i, t = F.col("id"), F.col("ts")
    end = F.when(i % 11 != 0, t + (i % 31) * 2000 - 10000)
    x = ticks(spark, sf).select("ts", (t - (i % 97) * 1000).alias("start"), end.alias("end"), "price", (i % 2).cast("double").alias("outcome"), (F.col("usdc") * F.col("side")).alias("pnl"))
    return signals.life_price_grid(x).select("life", "bucket", "margin", "n", *r6(win_rate="win_rate", mean_price="mean_price", edge="edge"), F.round("pnl", 4).alias("pnl"))


@query(f"""{_W}, x0 AS (SELECT id, price, usdc * side * 20 AS w, (id % 30)::DOUBLE AS days, id % 3 = 1 AS yes FROM ticks), x AS (SELECT *, greatest(-6e0, least(6e0, w / 4000 / sqrt(2e0))) AS x, CASE WHEN (w > 0) = yes THEN price ELSE 1 - price END AS p FROM x0)
SELECT id, round(0.5 + 0.49 * tanh(w / 5000) - price, 6) AS edge_tanh,
 round(greatest(0.01e0, least(0.99e0, 0.5 + 0.5 * exp(-x * x) * list_sum([pow(x, 2 * n + 1) / gamma(n + 1.5) FOR n IN range(0, 140)]) * exp(-0.01 * days))) - price, 6) AS edge_normal,
 price > 0.05 AND price < 0.95 AND (coalesce((1 - p) / nullif(p, 0) * (365 / nullif(days, 0)) > 5, false) OR days <= 0) AS gate,
 round(greatest(-0.1e0, least(0.1e0, 0.02 - 0.01 * ln(greatest(abs(w), 1e0)))), 6) AS fallback, round(greatest(0.1e0, least(0.35e0, 0.3 - 0.02 * ln(greatest(abs(w), 1e0)))), 6) AS fallback_brier FROM x""")
def q19b_edges(spark, sf):
    x = ticks(spark, sf).select("id", "price", (F.col("usdc") * F.col("side") * 20).alias("w"), (F.col("id") % 30).cast("double").alias("days"))
    w, p, d = F.col("w"), F.col("price"), F.col("days")
    return x.select("id", *r6(edge_tanh=signals.edge_tanh(w, p), edge_normal=signals.edge_normal(w, p, d, 2000.0), fallback=signals.fallback_score(F.abs(w), -0.01, 0.02), fallback_brier=signals.fallback_score(F.abs(w), -0.02, 0.3, 0.10, 0.35)), signals.roi_gate(p, w, d, F.col("id") % 3 == 1).alias("gate"))


@query(f"""{_W}, s AS (SELECT id, contract, ts, sum(usdc * side) OVER (PARTITION BY contract ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS signal FROM ticks),
e AS (SELECT contract, min(ts) AS t0, arg_min(signal, id) AS s0 FROM s GROUP BY contract)
SELECT contract, id, ts, round(signal, 4) AS signal FROM (SELECT s.*, row_number() OVER (PARTITION BY s.contract ORDER BY ts, id) AS rn FROM s JOIN e USING (contract) WHERE ts > t0 AND abs(signal - s0) > 1000) WHERE rn = 1""")
def q19c_smart_exit(spark, sf):
    w = signals.running(None, "contract")
    s = ticks(spark, sf).select("id", "contract", "ts", F.sum(F.col("usdc") * F.col("side")).over(w).alias("signal"))
    e = s.groupBy("contract").agg(F.min("ts").alias("ts"), F.min_by("signal", "id").alias("signal"))
    return signals.smart_exits(s, e, 0.5, 2000.0).select("contract", "id", "ts", F.round("signal", 4).alias("signal"))


_HIST = f"""{_W}, h AS (
  SELECT id, wallet, side > 0 AS yes, CAST(greatest(0, least(1000, floor(1000 * CASE WHEN side > 0 THEN price ELSE 1 - price END + 1e-9))) AS INTEGER) AS price_int,
         CAST(least(floor(1000 * ln(greatest(1e0, ((id * 7919) % 900000) / 3600e0)) + 1e-9), 2097151) AS INTEGER) AS log_ttr, id % 2 = 0 AS win, CAST(floor(ts / 86400) AS BIGINT) AS day FROM ticks)"""


def _history(spark, sf):
    t = ticks(spark, sf)
    ep = F.when(F.col("side") > 0, F.col("price")).otherwise(1 - F.col("price"))
    c = bayes.pack(ep, ((F.col("id") * 7919) % 900000).cast("double"))
    return t.select("id", "wallet", (F.col("side") > 0).alias("yes"), c["price_int"].alias("price_int"), c["log_ttr"].alias("log_ttr"), (F.col("id") % 2 == 0).alias("win"), F.floor(F.col("ts") / 86400).alias("day"))


@query(f"{_HIST} SELECT id, price_int, log_ttr, (price_int::BIGINT << 22) | (log_ttr::BIGINT << 1) | win::INT::BIGINT AS word FROM h")
def q52_bayes_pack(spark, sf):
    return _history(spark, sf).select("id", "price_int", "log_ttr", bayes.packed_word(F.col("price_int"), F.col("log_ttr"), F.col("win")).alias("word"))


_SCAN = f"""{_HIST}, s AS (SELECT id, wallet, log_ttr, day, yes AS hy, price_int AS p, true AS own FROM h UNION ALL SELECT id, wallet, log_ttr, day, NOT yes, 1000 - price_int, false FROM h),
k AS (SELECT s.id, pow(0.5e0, abs(h.price_int - p) / 25e0) * pow(0.5e0, abs(h.log_ttr - s.log_ttr) / 91e0) AS w, h.win = own AS hit
      FROM s JOIN h ON h.wallet = s.wallet AND h.yes = s.hy AND h.day < s.day AND abs(h.price_int - p) <= 100 AND abs(h.log_ttr - s.log_ttr) <= 604),
g AS (SELECT id, sum(w) AS n, sum(CASE WHEN hit THEN w ELSE 0e0 END) AS w, count(*) AS entries FROM k GROUP BY id)"""


@query(f"{_SCAN} SELECT id, entries, round(n, 6) AS n, round(w, 6) AS w FROM g")
def q53_bayes_scan(spark, sf):
    h = _history(spark, sf)
    return bayes.scan(h, h).select("id", "entries", *r6(n="n", w="w"))


@query(f"""{_SCAN}, b AS (SELECT wallet, avg(pow(price_int / 1000e0 - win::INT, 2)) * count(*) AS bs, count(*) AS m FROM h GROUP BY wallet),
x AS (SELECT g.id, price_int / 1000e0 AS p, g.n, g.w, 1 / (least(1e0, bs / m + 0.5 / sqrt(m)) + 0.01) AS t FROM g JOIN h USING (id) JOIN b USING (wallet)),
y AS (SELECT *, greatest(1e0, p * (1 - p) / greatest(1e-4, p * (1 - p)) - 1) AS prior FROM x)
SELECT id, round(t, 6) AS trust, round((w * t + prior * p) / (n * t + prior), 6) AS prob, round((w * t + prior * p) / (n * t + prior) - p, 6) AS margin FROM y""")
def q54_bayes_posterior(spark, sf):
    h = _history(spark, sf)
    b = h.groupBy("wallet").agg((F.avg(F.pow(F.col("price_int") / 1000.0 - F.col("win").cast("int"), 2)) * F.count("*")).alias("bs"), F.count("*").alias("m"))
    x = bayes.scan(h, h).join(h.select("id", "wallet", (F.col("price_int") / 1000.0).alias("p")), "id").join(b, "wallet").withColumn("t", bayes.trust(F.col("bs"), F.col("m")))
    c = bayes.posterior(F.col("p"), F.col("n"), F.col("w"), F.col("t"))
    return x.select("id", *r6(trust="t", prob=c["prob"], margin=c["margin"]))


@query(f"""{_W}, x AS (SELECT contract, price AS a, price * price AS b, pow(price - (id % 2), 2) AS y FROM ticks),
s AS (SELECT contract, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(b) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS vy FROM x GROUP BY contract),
d AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s)
SELECT contract, CAST(n AS BIGINT) AS n, round((y * (aa * bb - ab * ab) - a * (ay * bb - ab * vy) + b * (ay * ab - aa * vy)) / nullif(det, 0), 5) AS c0,
       round((n * (ay * bb - ab * vy) - y * (a * bb - ab * b) + b * (a * vy - ay * b)) / nullif(det, 0), 5) AS c1,
       round((n * (aa * vy - ay * ab) - a * (a * vy - ay * b) + y * (a * ab - aa * b)) / nullif(det, 0), 5) AS c2 FROM d""")
def q55_variance_fit(spark, sf):
    x = ticks(spark, sf).select("contract", "price", F.pow(F.col("price") - F.col("id") % 2, 2).alias("y"))
    return fresh.quadratic_fit(x, "y", "price", "contract").select("contract", F.col("n").cast("long").alias("n"), *(F.round(c, 5).alias(c) for c in ("c0", "c1", "c2")))


def q55b_bayes_wager(spark, sf):
    t = ticks(spark, sf).select("id", "ts", "wallet", F.col("usdc").alias("invest"), "price", (F.col("side") > 0).alias("yes"))
    back = t.where("id % 3 <> 0").select((F.col("ts") + 86400 * (1 + F.col("id") % 4)).alias("ts"), "wallet", F.when(F.col("id") % 10 == 1, 2 * F.col("invest")).otherwise(F.col("invest")).alias("invest"))
    return bayes.wager(t, back).select("id", "wallet", *r6(fraction="fraction", p_true="p_true"))


query(f"""{_W}, u AS (SELECT id, ts, wallet, usdc AS i, price, side, 1 AS kind FROM ticks UNION ALL SELECT NULL, ts + 86400 * (1 + id % 4), wallet, -CASE WHEN id % 10 = 1 THEN 2 * usdc ELSE usdc END, NULL, NULL, 0 FROM ticks WHERE id % 3 <> 0),
s AS (SELECT *, sum(i) OVER w AS s FROM u WINDOW w AS (PARTITION BY wallet ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, s - least(0e0, min(s) OVER w) AS ex FROM s WINDOW w AS (PARTITION BY wallet ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, max(ex) OVER w AS peak, row_number() OVER w AS n FROM e WHERE kind = 1 WINDOW w AS (PARTITION BY wallet ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, coalesce(lag(peak) OVER (PARTITION BY wallet ORDER BY ts, id), 0e0) AS old FROM p),
g AS (SELECT *, (sum(peak - old) OVER w - (peak - old) - old) / sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER w AS m FROM o WINDOW w AS (ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, least(1e0, i / greatest(i, peak, (n * peak + 5 * m) / (n + 5))) AS f FROM g)
SELECT id, wallet, round(f, 6) AS fraction, round(greatest(0.001e0, least(0.999e0, CASE WHEN side > 0 THEN price + f * (1 - price) ELSE price - f * price END)), 6) AS p_true FROM f""")(q55b_bayes_wager)


@query(f"""{_W}, x AS (SELECT wallet, (side > 0) AS yes, price, id % 7 AS k, CASE WHEN id % 7 = 0 THEN 0.5e0 WHEN id % 2 = 0 THEN 1e0 ELSE 0e0 END AS o, id FROM ticks)
SELECT id AS contract_id, CASE WHEN k <> 0 THEN CASE WHEN yes THEN o > 0.5 ELSE o < 0.5 END END AS win, round(CASE WHEN k <> 0 OR id % 2 = 0 THEN pow(price - o, 2) END, 6) AS brier FROM x""")
def q55c_bayes_resolve(spark, sf):
    t = ticks(spark, sf)
    pos = t.select("wallet", F.col("id").alias("contract_id"), (F.col("side") > 0).alias("yes"), F.lit(0).alias("price_int"), F.lit(0).alias("log_ttr"), F.col("price").alias("p_true"))
    out = t.select(F.col("id").alias("contract_id"), F.when(F.col("id") % 7 == 0, 0.5).when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("outcome"), (F.col("id") % 2 == 0).alias("confirmed"), F.lit(0).alias("day"))
    return bayes.resolve(pos, out).select("contract_id", "win", *r6(brier="brier"))


_PATH = {"h1": 3600, "h6": 21600, "h24": 86400}


@query(f"""{_W}, l AS (SELECT contract, ts, arg_max(price, id) AS price FROM ticks GROUP BY ALL)
SELECT id, {', '.join(f'round(t.price - (SELECT arg_max(l.price, l.ts) FROM l WHERE l.contract = t.contract AND l.ts <= t.ts - {s}), 6) AS {n}' for n, s in _PATH.items())},
round((SELECT max(m.price) FROM ticks m WHERE m.contract = t.contract AND m.ts BETWEEN t.ts - 86400 AND t.ts) - t.price, 6) AS down24 FROM ticks t""")
def q33_q34_path_features(spark, sf):
    """Of several rows at a time the one with the largest id stands for it, in the look back; every row gets its features."""
    x = features.path_features(ticks(spark, sf), "contract", _PATH, 86400)
    return x.select("id", *r6(**{n: n for n in _PATH}, down24="down"))


@query(f"""{_W}, o AS (SELECT * FROM ticks), j AS (SELECT o.id AS order_id, o.side AS os, o.usdc AS wanted, f.*, CASE WHEN o.side > 0 THEN f.price ELSE 1 - f.price END AS each FROM o JOIN ticks f ON f.contract = o.contract AND f.ts BETWEEN o.ts AND o.ts + 300 AND f.id <> o.id AND f.side = -o.side
  AND CASE WHEN o.side > 0 THEN f.price <= o.price ELSE f.price >= o.price END AND f.price > 0.001 AND f.price < 0.999),
t AS (SELECT *, coalesce(sum(usdc / price * 0.5 * each) OVER (PARTITION BY order_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM j),
k AS (SELECT *, least(usdc / price * 0.5 * each, wanted - before) AS took FROM t WHERE before < wanted * 0.999),
g AS (SELECT order_id, os, sum(took) AS filled, sum(took / each) AS shares, count(*) AS fills FROM k WHERE took / each > 1e-6 GROUP BY ALL)
SELECT order_id, round(filled, 4) AS filled, round(CASE WHEN os > 0 THEN filled / shares ELSE 1 - filled / shares END, 6) AS price, fills FROM g""")
def q35_match_flow(spark, sf):
    """Every tick as an order against the ticks of its contract."""
    t = ticks(spark, sf)
    return execution.match_flow(t, t).select("order_id", F.round("filled", 4).alias("filled"), F.round("price", 6).alias("price"), "fills")


_WALK = """, w AS (SELECT *, greatest(0e0, least(price * size, 500 - coalesce(sum(price * size) OVER (PARTITION BY contract ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))) AS spent FROM l)
SELECT contract, round(sum(spent), 4) AS spent, round(sum(spent / price), 4) AS quantity, round(max(price), 6) AS worst, round(sum(spent) / nullif(sum(spent / price), 0), 6) AS vwap FROM w WHERE spent > 0 GROUP BY contract"""


def _levels(spark, sf):
    return ticks(spark, sf).groupBy("contract", "price").agg(F.sum("usdc").alias("size"))


@query(f"{_W}, l AS (SELECT contract, price, sum(usdc) AS size FROM ticks GROUP BY ALL){_WALK}")
def q36_vwap_walk(spark, sf):
    g = execution.vwap_walk(_levels(spark, sf), 500.0, "contract")
    return g.select("contract", F.round("spent", 4).alias("spent"), F.round("quantity", 4).alias("quantity"), *r6(worst="worst", vwap="vwap"))


@query(f"""{_W}, l0 AS (SELECT contract, price, sum(usdc) / 50 AS size FROM ticks GROUP BY ALL), l AS (SELECT *, 0.02 AS signal, 0.009 AS bid, min(price) OVER (PARTITION BY contract) AS ask FROM l0),
w AS (SELECT *, greatest(0e0, least(price * size, 500 - coalesce(sum(price * size) OVER (PARTITION BY contract ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))) AS spent FROM l),
m AS (SELECT *, sum(spent) OVER v / sum(spent / price) OVER v AS mean FROM w WHERE spent > 0 WINDOW v AS (PARTITION BY contract ORDER BY price ROWS UNBOUNDED PRECEDING))
SELECT contract, round(sum(spent), 4) AS spent, round(sum(spent / price), 4) AS quantity, round(max(price), 6) AS worst, round(sum(spent) / nullif(sum(spent / price), 0), 6) AS vwap
FROM m WHERE NOT ((mean - signal) / signal + (ask - bid) / ask > 0.6 AND mean - signal > 0.005) GROUP BY contract""")
def q36b_sweep_limit(spark, sf):
    l = _levels(spark, sf).withColumns({"size": F.col("size") / 50, "signal": F.lit(0.02), "best_bid": F.lit(0.009)})
    g = execution.sweep_limit(l, 500.0, 0.6, 0.005, "contract")
    return g.select("contract", F.round("spent", 4).alias("spent"), F.round("quantity", 4).alias("quantity"), *r6(worst="worst", vwap="vwap"))


@query(f"""{_W}, x AS (SELECT *, least(0.2e0, 0.01 + 20000 / (greatest(1000e0, usdc * 50) + 1000) * 0.0025) AS s FROM ticks),
y AS (SELECT *, greatest(0e0, CASE WHEN side < 0 THEN price - s ELSE price END) AS b, least(1e0, CASE WHEN side < 0 THEN price ELSE price + s END) AS a FROM x)
SELECT id, round(b, 6) AS bid, round(CASE WHEN b > a THEN least(1e0, b + 0.001) ELSE a END, 6) AS ask, round(greatest(100e0, usdc / price * 2), 4) AS depth FROM y""")
def q37_synth_quotes(spark, sf):
    return execution.synth_quotes(ticks(spark, sf).withColumn("size", F.col("usdc") / F.col("price"))).select("id", "bid", "ask", "depth")


@query("""WITH m AS (SELECT event_id AS seq, event_type AS token, CASE WHEN event_id % 1000 = 1 THEN 'book' ELSE 'delta' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, round((event_id % 40) / 100e0, 2) AS price,
  CASE WHEN event_id % 9 = 0 THEN 0e0 ELSE value END AS size FROM events),
x AS (SELECT m.* FROM m JOIN (SELECT token, max(seq) AS since FROM m WHERE kind = 'book' GROUP BY token) USING (token) WHERE seq >= since),
l AS (SELECT token, side, price, arg_max(size, seq) AS size FROM x GROUP BY ALL)
SELECT token, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask FROM l WHERE size > 0 GROUP BY token""")
def q38_book_state(spark, sf):
    e = table(spark, sf, "events")
    m = e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("token"), F.when(F.col("event_id") % 1000 == 1, "book").otherwise("delta").alias("kind"), F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.round((F.col("event_id") % 40) / 100.0, 2).cast("string").alias("price"), F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value")).alias("size"),
    )
    return execution.best_quotes(execution.book_state(m))


@query(f"""{_W} SELECT id, wallet, contract, round(sum(usdc / price) OVER w, 4) AS qty, round(sum(usdc) OVER w / nullif(sum(usdc / price) OVER w, 0), 6) AS avg_cost FROM ticks WHERE side > 0 WINDOW w AS (PARTITION BY wallet, contract ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
def q39_average_cost(spark, sf):
    return execution.average_cost(ticks(spark, sf)).select("id", "wallet", "contract", F.round("qty", 4).alias("qty"), *r6(avg_cost="avg_cost"))


@query(f"""{_W.replace("WITH", "WITH RECURSIVE", 1)}, f AS (SELECT wallet, contract, side, usdc / price AS q, price AS p, row_number() OVER (PARTITION BY wallet, contract ORDER BY ts, id) AS n, count(*) OVER (PARTITION BY wallet, contract) AS last FROM ticks),
r AS (SELECT wallet, contract, 0::BIGINT AS n, 0e0 AS qty, 0e0 AS cost, 0e0 AS gained FROM f WHERE n = 1 UNION ALL
 SELECT r.wallet, r.contract, f.n, CASE WHEN f.side > 0 THEN r.qty + f.q ELSE r.qty - least(f.q, r.qty) END, CASE WHEN f.side > 0 THEN r.cost + f.q * f.p WHEN r.qty > 0 THEN r.cost - least(f.q, r.qty) * r.cost / r.qty ELSE r.cost END,
  CASE WHEN f.side < 0 AND r.qty > 0 THEN r.gained + least(f.q, r.qty) * (f.p - r.cost / r.qty) ELSE r.gained END FROM r JOIN f ON f.wallet = r.wallet AND f.contract = r.contract AND f.n = r.n + 1)
SELECT r.wallet, r.contract, round(qty, 4) AS qty, round(CASE WHEN qty > 1e-9 THEN cost / qty ELSE 0e0 END, 4) AS avg_cost, round(gained, 4) AS realised FROM r JOIN f ON f.wallet = r.wallet AND f.contract = r.contract AND f.n = r.n AND f.n = f.last""")
def q39b_positions_with_sales(spark, sf):
    g = execution.positions_with_sales(ticks(spark, sf).select("wallet", "contract", "ts", "id", "side", (F.col("usdc") / F.col("price")).alias("qty"), "price"))
    return g.select("wallet", "contract", *(F.round(c, 4).alias(c) for c in ("qty", "avg_cost", "realised")))


@query(f"""{_W.replace("WITH", "WITH RECURSIVE", 1)}, m AS (SELECT id, contract, usdc, abs(price - lag(price) OVER w) AS d, row_number() OVER w AS n FROM ticks WINDOW w AS (PARTITION BY contract ORDER BY ts, id)),
r AS (SELECT contract, 0::BIGINT AS n, NULL::BIGINT AS id, 10000e0 AS l FROM m WHERE n = 1 UNION ALL
 SELECT r.contract, m.n, m.id, CASE WHEN m.d > 0.005 AND m.usdc > 10 THEN 0.9e0 * r.l + 0.1e0 * 0.5e0 * m.usdc / m.d ELSE r.l END FROM r JOIN m ON m.contract = r.contract AND m.n = r.n + 1)
SELECT contract, id, round(l, 4) AS liquidity FROM r WHERE id IS NOT NULL""")
def q39c_implied_liquidity(spark, sf):
    return execution.implied_liquidity(ticks(spark, sf)).select("contract", "id", F.round("liquidity", 4).alias("liquidity"))


_EQ = f"""{_W}, d AS (SELECT contract AS key, CAST(floor(ts / 86400) AS BIGINT) AS day, sum(usdc * side * (price - 0.33)) AS pnl FROM ticks GROUP BY ALL),
e AS (SELECT *, 10000e0 + sum(pnl) OVER (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM d),
f AS (SELECT *, greatest(max(equity) OVER (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING), 10000e0) AS peak, coalesce(lag(equity) OVER (PARTITION BY key ORDER BY day), 10000e0) AS prev FROM e),
q AS (SELECT *, (peak - equity) / nullif(peak, 0) AS drawdown, equity / nullif(prev, 0) - 1 AS ret FROM f)"""


def _equity(spark, sf):
    p = ticks(spark, sf).select(F.col("contract").alias("key"), F.floor(F.col("ts") / 86400).alias("day"), (F.col("usdc") * F.col("side") * (F.col("price") - 0.33)).alias("pnl"))
    return performance.daily_equity(p)


@query(f"{_EQ} SELECT key, day, round(equity, 4) AS equity, round(drawdown, 6) AS drawdown, round(ret, 6) AS ret FROM q")
def q40_daily_equity(spark, sf):
    return _equity(spark, sf).select("key", "day", F.round("equity", 4).alias("equity"), *r6(drawdown="drawdown", ret="ret"))


@query(f"""{_EQ}, c AS (SELECT key, unnest(range(min(day), max(day) + 1)) AS day FROM q GROUP BY key),
filled AS (SELECT c.key, c.day, last_value(equity IGNORE NULLS) OVER (PARTITION BY c.key ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS equity FROM c LEFT JOIN q ON q.key = c.key AND q.day = c.day),
r AS (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, max(equity) OVER w AS peak FROM filled WINDOW w AS (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING)),
g AS (SELECT key, max(day) - min(day) AS days, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, max((peak - equity) / nullif(peak, 0)) AS mdd, arg_max(equity, day) AS l FROM r GROUP BY key),
p AS (SELECT key, sum(greatest(pnl, 0e0)) AS won, sum(least(pnl, 0e0)) AS lost, avg(pnl) AS ex FROM q GROUP BY key),
h AS (SELECT *, CASE WHEN days > 0 THEN pow(greatest(l / 10000, 0e0), 365e0 / days) - 1 END AS cagr FROM g JOIN p USING (key))
SELECT key, days, round(sqrt(365) * m / nullif(sd, 0), 5) AS sharpe, round(sqrt(365) * m / nullif(dn, 0), 5) AS sortino, round(cagr / nullif(mdd, 0), 4) AS calmar, round(cagr, 5) AS cagr, round(mdd, 6) AS max_drawdown, round(won / nullif(-lost, 0), 6) AS profit_factor, round(ex, 5) AS expectancy FROM h""")
def q41_metrics(spark, sf):
    g = performance.metrics(_equity(spark, sf))
    return g.select("key", "days", *(F.round(c, 5).alias(c) for c in ("sharpe", "sortino", "cagr", "expectancy")), F.round("calmar", 4).alias("calmar"), *r6(max_drawdown="max_drawdown", profit_factor="profit_factor"))


@query(f"""{_EQ}, u AS (SELECT *, (equity < peak)::INT AS under FROM q), i AS (SELECT *, sum(1 - under) OVER (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM u)
SELECT key, CAST(max(run) AS BIGINT) AS longest FROM (SELECT key, island, sum(under) AS run FROM i GROUP BY ALL) GROUP BY key""")
def q42_underwater(spark, sf):
    return performance.longest_underwater(_equity(spark, sf))


@query(f"{_EQ} SELECT key, min(day) AS halt_day FROM q WHERE drawdown > 0.0005 GROUP BY key")
def q42b_halt(spark, sf):
    return performance.halted(_equity(spark, sf), 0.0005)


_FOLDS = performance.folds(19723, 19753, 10, 2, 5)


@query(f"""{_W}, f AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b}, {c}, {d})' for i, (a, b, c, d) in enumerate(_FOLDS))}) t(fold, a, b, c, d)),
x AS (SELECT fold, usdc AS v, CASE WHEN day >= a AND day < b THEN 'train' WHEN day >= c AND day < d THEN 'test' END AS part FROM (SELECT usdc, CAST(floor(ts / 86400) AS BIGINT) AS day FROM ticks), f)
SELECT fold, round(avg(CASE WHEN part = 'train' THEN v END), 5) AS fitted, round(avg(CASE WHEN part = 'test' THEN v END), 5) AS seen, count(CASE WHEN part = 'test' THEN 1 END) AS n_test,
 round(avg(CASE WHEN part = 'test' THEN v END) - avg(CASE WHEN part = 'train' THEN v END), 5) AS error FROM x WHERE part IS NOT NULL GROUP BY fold""")
def q43_walk_forward(spark, sf):
    g = performance.walk_forward(ticks(spark, sf).select(F.floor(F.col("ts") / 86400).alias("day"), F.col("usdc").alias("value")), _FOLDS)
    return g.select("fold", "n_test", *(F.round(c, 5).alias(c) for c in ("fitted", "seen", "error")))


@query(f"""{_W}, s AS (SELECT contract, avg(usdc) AS mu, stddev_pop(usdc) AS sd, min(ts) AS t0, max(ts) AS t1 FROM ticks GROUP BY contract), u AS (SELECT wallet, dense_rank() OVER (ORDER BY wallet) - 1 AS u_id FROM (SELECT DISTINCT wallet FROM ticks)),
x AS (SELECT *, ((ts // 3600) % 24) * {2 * math.pi / 24!r} AS h FROM ticks JOIN s USING (contract) JOIN u USING (wallet))
SELECT id, CAST(u_id AS INTEGER) AS u_id, round((usdc - mu) / nullif(sd, 0), 6) AS z, round(ln(1 + usdc), 6) AS log_usdc, round((ts - t0) / nullif((t1 - t0)::DOUBLE, 0), 6) AS progress, round(sin(h), 6) AS hour_sin, round(cos(h), 6) AS hour_cos FROM x""")
def q46_graph_features(spark, sf):
    g = features.temporal_graph_features(ticks(spark, sf))
    return g.select("id", "u_id", *r6(z="z", log_usdc="log_usdc", progress="progress", hour_sin="hour_sin", hour_cos="hour_cos"))


@query(f"""{_W} SELECT id, round(ln(1 + usdc), 6) AS log_vol, price, (ts // 3600) % 24 AS hour, (ts // 86400 + 3) % 7 + 1 AS weekday, CAST(len(string_split(contract || ' ' || props, ' ')) AS INTEGER) AS words, CASE WHEN side > 0 THEN 1 ELSE 0 END AS is_long FROM ticks""")
def q46b_ml_vector(spark, sf):
    g = features.ml_vector(ticks(spark, sf), F.concat_ws(" ", "contract", "props"))
    return g.select("id", *r6(log_vol="log_vol"), "price", "hour", "weekday", "words", "is_long")


@query(f"""{_W}, c AS (SELECT unnest(range((SELECT min(ts) // 3600 FROM ticks), (SELECT max(ts) // 3600 FROM ticks) + 1)) AS hour), k AS (SELECT DISTINCT contract FROM ticks),
v AS (SELECT contract, ts // 3600 AS hour, sum(usdc) AS v, arg_max(price, id) AS p FROM ticks GROUP BY ALL), g AS (SELECT k.contract, c.hour, coalesce(v, 0) AS v, p FROM k CROSS JOIN c LEFT JOIN v ON v.contract = k.contract AND v.hour = c.hour)
SELECT contract, hour, round(v, 4) AS volume, round(avg(v) OVER (PARTITION BY contract), 4) AS baseline, last_value(p IGNORE NULLS) OVER (PARTITION BY contract ORDER BY hour ROWS UNBOUNDED PRECEDING) AS price FROM g""")
def q56_hourly_baseline(spark, sf):
    t = ticks(spark, sf).withColumn("hour", F.floor(F.col("ts") / 3600))
    lo, hi = t.agg(F.min("hour"), F.max("hour")).first()
    hours = t.select("contract").distinct().withColumn("hour", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    g = hours.join(t.groupBy("contract", "hour").agg(F.sum("usdc").alias("v"), F.max_by("price", "id").alias("p")), ["contract", "hour"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    by = Window.partitionBy("contract")
    return g.select("contract", "hour", F.round("v", 4).alias("volume"), F.round(F.avg("v").over(by), 4).alias("baseline"), F.last("p", ignorenulls=True).over(by.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)).alias("price"))


@query(f"""{_W} SELECT contract, ts // 14400 AS bin, count(*) AS n, round(quantile_cont(usdc, 0.25), 6) AS q25, round(quantile_cont(usdc, 0.5), 6) AS q50, round(quantile_cont(usdc, 0.75), 6) AS q75 FROM ticks GROUP BY ALL""")
def q57_quantile_bands(spark, sf):
    g = ticks(spark, sf).groupBy("contract", F.floor(F.col("ts") / 14400).alias("bin")).agg(F.count("*").alias("n"), F.percentile("usdc", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return g.select("contract", "bin", "n", *(F.round(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((25, 50, 75))))


@query(f"""{_W} SELECT a, b, round(cov, 5) AS cov FROM (SELECT unnest(['usdc', 'usdc', 'usdc', 'price', 'price', 'side']) AS a, unnest(['usdc', 'price', 'side', 'price', 'side', 'side']) AS b,
unnest([covar_samp(usdc, usdc), covar_samp(usdc, price), covar_samp(usdc, side), covar_samp(price, price), covar_samp(price, side), covar_samp(side, side)]) AS cov FROM ticks)""")
def q58_covariance(spark, sf):
    return features.covariance(ticks(spark, sf), ["usdc", "price", "side"]).select("a", "b", F.round("cov", 5).alias("cov"))


@query(f"""{_W}, x AS (SELECT id, CASE WHEN id % 50 = 0 THEN 1e0 WHEN id % 50 = 1 THEN 0e0 ELSE price END AS m, greatest(0::DOUBLE, price - 0.1) AS lo, least(1::DOUBLE, price + CASE WHEN id % 7 = 0 THEN 0.9 ELSE 0.1 END) AS hi, 0.05 + (id % 20) / 100e0 AS br, price AS m2 FROM ticks),
w AS (SELECT *, pow((hi - lo) / 4, 2) AS v, NOT (lo >= 0 AND lo <= m AND m <= hi AND hi <= 1) OR hi = lo OR m * (1 - m) < pow((hi - lo) / 4, 2) AS weak FROM x),
n AS (SELECT *, CASE WHEN m * (1 - m) / nullif(v, 0) - 1 <= 0 THEN 1e-6 ELSE m * (1 - m) / nullif(v, 0) - 1 END AS n1, greatest(m2 * (1 - m2) / greatest(br, 1e-6) - 1, 1e-6) AS n2 FROM w),
y AS (SELECT *, CASE WHEN m = 0 THEN 1e0 WHEN m = 1 THEN 'inf'::DOUBLE WHEN weak THEN 1e0 ELSE m * n1 END AS a1, CASE WHEN m = 0 THEN 'inf'::DOUBLE WHEN m = 1 THEN 1e0 WHEN weak THEN 1e0 ELSE (1 - m) * n1 END AS b1 FROM n),
z AS (SELECT id, greatest(1 + (a1 - 1) + (m2 * n2 - 1), 1e-3) AS a, greatest(1 + (b1 - 1) + ((1 - m2) * n2 - 1), 1e-3) AS b FROM y)
SELECT id, round(CASE WHEN isinf(a) THEN 1e0 WHEN isinf(b) THEN 0e0 ELSE a / (a + b) END, 6) AS mean, round(CASE WHEN isinf(a) OR isinf(b) THEN 0e0 ELSE a * b / ((a + b) * (a + b) * (a + b + 1)) END, 6) AS variance FROM z""")
def q59_beta_fusion(spark, sf):
    i, p = F.col("id"), F.col("price")
    m = F.when(i % 50 == 0, 1.0).when(i % 50 == 1, 0.0).otherwise(p)
    one = features.beta_from_interval(m, F.greatest(F.lit(0.0), p - 0.1), F.least(F.lit(1.0), p + F.when(i % 7 == 0, 0.9).otherwise(0.1)))
    two = features.beta_from_brier(p, F.lit(0.05) + (i % 20) / 100.0)
    f = features.fuse_betas(one["alpha"], one["beta"], two["alpha"], two["beta"])
    return ticks(spark, sf).select("id", *r6(mean=f["mean"], variance=f["variance"]))


@query(f"""{_W} SELECT id, round(f * least(1e0, 0.15 / nullif(sum(abs(f)) OVER (PARTITION BY c), 0)), 6) AS capped FROM (SELECT id, (price - 0.5) / 10 AS f, id % 100 AS c FROM ticks)""")
def q59b_kelly_cap(spark, sf):
    b = ticks(spark, sf).select("id", ((F.col("price") - 0.5) / 10).alias("fraction"), (F.col("id") % 100).alias("cluster"))
    return features.kelly_cap(b).select("id", *r6(capped="capped"))


@query(f"""{_W}, x AS (SELECT id, price - 0.5 AS e, sqrt(price * (1 - price)) AS sd, id % 500 AS c FROM ticks), s AS (SELECT c, count(*) AS n, sum(e / sd) AS s FROM x GROUP BY c),
f AS (SELECT id, c, (e / sd - 0.2e0 / (0.8e0 + 0.2e0 * n) * s) / (sd * 0.8e0) AS f FROM x JOIN s USING (c)) SELECT CAST(c AS INTEGER) AS cluster, id, round(f * least(1e0, 0.8e0 / nullif(sum(abs(f)) OVER (PARTITION BY c), 0)), 6) AS fraction FROM f""")
def q59c_kelly_cluster(spark, sf):
    b = ticks(spark, sf).select("id", (F.col("price") - 0.5).alias("edge"), (F.col("price") * (1 - F.col("price"))).alias("variance"), (F.col("id") % 500).cast("int").alias("cluster"))
    return features.kelly_cluster(b, 0.2, 0.8).select("cluster", "id", *r6(fraction="fraction"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events""")
def q60_json_paths(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))
