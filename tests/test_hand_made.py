"""Small cases worked out by hand from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from emberlake.functions import normalize as nz
from emberlake.operators import bayes, execution, features, fills, markets as mk, performance, positions, signals


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_outcomes(spark):
    rows = [(1, 0, 1.0), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 1.0), (3, 0, 0.5), (3, 1, 0.5), (4, 0, None), (4, 1, None), (5, 0, 0.0), (5, 1, 0.0)]
    t = spark.createDataFrame([(m, 10 * m + i, i, o) for m, i, o in rows], "market_id long, contract_id long, token_index int, outcome double")
    assert {r["market_id"]: r["class"] for r in mk.repair_class(t).collect()} == {1: "trusted", 2: "trusted", 3: "void", 4: "target", 5: "anomaly"}
    got = {r["contract_id"]: r["outcome"] for r in mk.authority(t).collect()}
    assert got == {10: 1.0, 11: 0.0, 20: 0.0, 21: 1.0, 30: 0.5, 31: 0.5, 40: None, 41: None, 50: None, 51: None}
    raw = [(1, '["a","b"]', '["0.97","0.03"]', "open"), (2, '["a","b"]', '["0.97","0.03"]', "Resolved"), (3, '["a"]', '["1"]', "resolved"), (4, "no json", '["1","0"]', "resolved"), (5, '["a","b"]', '["0.5","0.51"]', "closed")]
    x = mk.explode_tokens(spark.createDataFrame(raw, "market_id int, token_ids string, prices string, status string"))
    assert {(r["market_id"], r["token_index"]): r["payout"] for r in x.collect()} == {(1, 0): None, (1, 1): None, (2, 0): 1.0, (2, 1): 0.0, (5, 0): 0.5, (5, 1): 0.5}


def test_exclusion_by_each_clause(spark):
    hit = lambda size=None, source=None, sports=None, question=None: column(spark, mk.is_hostile(*(F.lit(x).cast(t) for x, t in ((size, "int"), (source, "string"), (sports, "string"), (question, "string")))))
    assert not hit() and not hit(999, "espn.com", "moneyline", "a whether Ethan")
    assert hit(1000) and hit(source="WWW.Binance.com/x") and hit(source="https://hltv.org") and hit(sports="cs2_odd_even_total_rounds") and hit(question="Price of ETH?") and hit(question="new Token")
    frozen = lambda fees=None, source=None, sports=None, live=None: column(spark, mk.is_hostile_frozen(*(F.lit(x).cast(t) for x, t in ((fees, "string"), (source, "string"), (sports, "string"), (live, "double")))))
    assert not frozen() and not frozen("no", "hltv.org", "cs2_odd_even_total_rounds", 0.0) and not frozen(live=3601.0)
    assert frozen("True") and frozen("1") and frozen(source="gol.gg") and frozen(sports="team_totals") and frozen(live=3600.0)
    topic = lambda q: column(spark, mk.topic(F.lit(q)))
    assert [topic(q) for q in ("Whether it rains", "ETH over 3k", "A vs. B", "Bitcoin game", "Senate vs game", "set 1 winner", "presets")] == ["other", "crypto", "sports", "sports", "politics", "sports", "other"]


def test_gates(spark):
    ts, none = F.lit(100), F.lit(None).cast("long")
    assert column(spark, mk.in_life(ts, F.lit(100), F.lit(100))) and not column(spark, mk.in_life(ts, F.lit(101), none)) and not column(spark, mk.in_life(ts, none, F.lit(99)))
    assert column(spark, mk.before_resolution(ts, none)) and not column(spark, mk.before_resolution(ts, F.lit(100)))
    gate = lambda p, w, d, yes: column(spark, signals.roi_gate(F.lit(p), F.lit(w), F.lit(d), F.lit(yes)))
    assert gate(0.5, 1.0, 72.0, True) and not gate(0.5, 1.0, 74.0, True)  # a return of 1 in 72 days is 5.07 a year
    assert gate(0.9, -1.0, 600.0, True) and not gate(0.9, 1.0, 600.0, True) and gate(0.9, 1.0, 600.0, False) and gate(0.9, 1.0, -1.0, True) and not gate(0.96, -1.0, 1.0, True)
    assert column(spark, signals.smart_exit(F.lit("YES"), F.lit(499.0), 1000.0, 0.5)) and not column(spark, signals.smart_exit(F.lit("NO"), F.lit(-501.0), 1000.0, 0.5))


def test_identifiers_and_times(spark):
    a = "0xABCDEF0123456789abcdef0123456789ABCDEF01"
    got = spark.createDataFrame([(a,), ("0x" + "0" * 24 + a[2:],), ("bad",), (None,)], "w string").select(nz.wallet_key(F.col("w")).alias("k")).collect()
    assert [r["k"] for r in got] == [a.lower(), a.lower(), None, None]
    t = spark.createDataFrame([("1704067200",), ("1704067200.0",), ("2024-01-01 00:00:00",), ("2024-01-01T00:00:00Z",)], "t string").select(nz.seconds(nz.any_timestamp(F.col("t"))).alias("s")).collect()
    assert [r["s"] for r in t] == [1704067200] * 4
    long = "7" * 78
    assert column(spark, nz.contract_key(F.lit(f" 0x{long} "))) == long


def test_fills(spark):
    rows = [("sell", "a", "b", "usd", "7", 100, 200), ("buy", "a", "b", "7", "usd", 300, 100), ("zero", "a", "b", "7", "usd", 0, 0), ("self", "a", "a", "7", "usd", 1, 2), ("exchange", "a", "x", "7", "usd", 1, 2)]
    l = spark.createDataFrame(rows, "id string, maker string, taker string, maker_asset string, taker_asset string, maker_amount long, taker_amount long")
    got = {r["id"]: (r["side_mult"], r["price"]) for r in fills.derive(fills.ingest_filter(l, ["x"]), "usd").collect()}
    assert got == {"sell": (-1, 0.5), "buy": (1, pytest.approx(1 / 3)), "zero": (1, None)}


def test_quotes(spark):
    t = spark.createDataFrame([(1, "c", 0.5, 100.0, 30.0, 1), (2, "c", 0.5, 100.0, 80.0, -1), (3, "c", 0.005, 1.0, 1.0, -1), (4, "c", 0.99, 1.0, 1.0, 1)], "id long, contract string, price double, usdc double, size double, side int")
    got = {r["id"]: (r["bid"], r["ask"], r["depth"]) for r in execution.synth_quotes(t).collect()}
    wide = 0.01 + 20000 / 6000 * 0.0025
    assert got[1] == (0.5, round(0.5 + wide, 6), 100.0) and got[2] == (round(0.5 - wide, 6), 0.5, 160.0)
    assert got[3] == (0.0, 0.005, 100.0) and got[4][:2] == (0.99, 1.0)


def test_sweep_stops_on_the_mean_price(spark):
    l = spark.createDataFrame([("c", 0.50, 100.0), ("c", 0.52, 100.0), ("c", 0.60, 1000.0)], "k string, price double, size double").withColumns({"signal": F.lit(0.50), "best_bid": F.lit(0.49)})
    one = lambda slippage, allowance: execution.sweep_limit(l, 500.0, slippage, allowance, "k").first()
    r = one(0.05, 0.01)  # the third level lifts the mean by 0.07, with 0.02 of spread: too much in either way
    assert (r["spent"], r["worst"]) == (pytest.approx(102.0), 0.52)
    assert one(0.05, 0.09)["spent"] == pytest.approx(500.0)  # but within the allowance


def test_flow(spark):
    row = "id long, contract string, ts long, side int, price double, usdc double"
    flow = spark.createDataFrame([(1, "c", 10, -1, 0.4, 40.0), (2, "c", 20, -1, 0.6, 60.0), (3, "c", 310, -1, 0.4, 400.0), (4, "c", 311, -1, 0.4, 400.0), (5, "c", 15, 1, 0.6, 60.0), (6, "c", 16, 1, 0.9995, 900.0)], row)
    orders = spark.createDataFrame([(100, "c", 5, 1, 0.5, 90.0), (101, "c", 5, -1, 0.5, 30.0), (102, "c", 400, 1, 0.9, 1.0)], row)
    got = {r["order_id"]: (r["filled"], r["price"], r["fills"]) for r in execution.match_flow(orders, flow).collect()}
    assert got[100] == (pytest.approx(90.0), pytest.approx(0.4), 2)  # 50 shares for 20 at the first trade, from which the 300 seconds count, 70 more at the third
    assert got[101] == (pytest.approx(20.0), pytest.approx(0.6), 1) and 102 not in got  # 50 shares at 1 - 0.6


def test_metrics(spark):
    e = spark.createDataFrame([("k", 1, 10_500.0, 500.0), ("k", 2, 9_900.0, -600.0), ("k", 5, 9_700.0, -200.0)], "key string, day long, equity double, pnl double")
    r = performance.metrics(e).first()
    ret = [9900 / 10500 - 1, 0.0, 0.0, 9700 / 9900 - 1]
    mean, low = sum(ret) / 4, [ret[0], ret[3]]
    down = math.sqrt(sum((x - sum(low) / 2) ** 2 for x in low))
    growth = (9700 / 10000) ** (365 / 4) - 1
    assert r["days"] == 4 and r["sortino"] == pytest.approx(mean * 365 / (down * math.sqrt(365))) and r["max_drawdown"] == pytest.approx(1 - 9700 / 10500)
    assert r["calmar"] == pytest.approx(growth / (1 - 9700 / 10500)) and r["profit_factor"] == pytest.approx(500 / 800)


def test_belief(spark):
    beta = lambda m, lo, hi: tuple(column(spark, F.struct(*(c.alias(n) for n, c in features.beta_from_interval(F.lit(m), F.lit(lo), F.lit(hi)).items()))))
    n = 0.25 / 0.05**2 - 1
    assert beta(0.5, 0.4, 0.6) == pytest.approx((0.5 * n, 0.5 * n)) and beta(0.0, 0.0, 0.1) == (1.0, math.inf) and beta(1.0, 0.9, 1.0) == (math.inf, 1.0)
    assert beta(0.5, 0.5, 0.5) == beta(0.5, 0.6, 0.7) == beta(1.5, 0.0, 1.0) == beta(0.01, 0.0, 1.0) == (1.0, 1.0)
    fused = features.fuse_betas(F.lit(math.inf), F.lit(1.0), F.lit(3.0), F.lit(4.0))
    assert (column(spark, fused["mean"]), column(spark, fused["variance"])) == (1.0, 0.0)


def test_wager_releases_exposure(spark):
    t = spark.createDataFrame([(1, 10, "a", 50.0, 0.5, True), (2, 20, "b", 10.0, 0.5, False), (3, 40, "a", 30.0, 0.4, True)], "id long, ts long, wallet string, invest double, price double, yes boolean")
    back = spark.createDataFrame([(30, "a", 80.0)], "ts long, wallet string, invest double")  # more than was in: exposure is 0, not less
    got = {r["id"]: r["fraction"] for r in bayes.wager(t, back).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(10 / ((10 + 5 * 25) / 6))  # wallet b: peak 10, all peaks before it 50 over 2 wallets
    assert got[3] == pytest.approx(30 / max(30, 50, (2 * 50 + 5 * 10 / 2) / 7))


def test_grid(spark):
    rows = [(0.049, 50, 0, 100, 1.0, 1.0), (0.39, 100, 0, 100, 0.0, -1.0), (0.8, 5, 0, 100, 0.0, -1.0), (0.05, 5, None, 100, 1.0, 2.0), (0.05, 5, 100, 100, 1.0, 2.0)]
    g = signals.life_price_grid(spark.createDataFrame(rows, "price double, ts long, start long, end long, outcome double, pnl double"))
    got = {(r["life"], r["bucket"], r["margin"]): r["n"] for r in g.collect()}
    assert {k: v for k, v in got.items() if k[2] == 0} == {(5, 0, 0): 1, (9, 7, 0): 1, (0, 7, 0): 1, (10, 1, 0): 2} and got[None, None, 3] == 5


def test_elite_gates(spark):
    row = "wallet long, contract_id long, invested double, pnl double, resolved_at long, first_ts long, n_trades long"
    day = 86400
    make = lambda w, size, gain: [(w, c, size, gain, (10 + c) * day, c * day, 1) for c in range(10)]
    rows = make(1, 100.0, 50.0) + make(2, 99.0, 50.0) + make(3, 100.0, 1.0) + make(4, 100.0, 60.0)[:9]
    got = positions.elite(spark.createDataFrame(rows, row)).collect()
    assert [r["wallet"] for r in got] == [1]  # 2 is too small, 3 earns a third a year, 4 has nine markets
    assert got[0]["annual"] == pytest.approx(500 * 365 / 20) and got[0]["score"] == pytest.approx(500 * 365 / 20 / 100)
    assert positions.elite(spark.createDataFrame(rows, row), as_of=15 * day).count() == 0
