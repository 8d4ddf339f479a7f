"""Replays against plain Python over all rows, and the models and sources that have no SQL."""

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.operators import execution, features, frames, fresh, intervals, simulate, windows
from emberlake.plans import extended
from emberlake.sources import tables
from emberlake.streaming import streams

SF = "/root/testdata/sf0.001"


def money(settle, rows, p):
    """Hourly settlement as a loop over every row. settle(row, state) may place a bet."""
    s = {"cash": p.bank, "equity": p.bank, "peak": p.bank, "pnl": 0.0, "dd": 0.0, "beat": None, "open": [], "bets": 0, "wins": 0}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        settle(r, s)
        if s["beat"] is None:
            s["beat"] = r["ts"]
        if r["ts"] - s["beat"] >= 3600:
            s["beat"] = r["ts"]
            for end, profit, stake in [x for x in s["open"] if x[0] <= r["ts"]]:
                s["pnl"] += profit
                s["equity"] += profit
                s["cash"] += profit + stake
            if s["open"]:
                s["open"] = [x for x in s["open"] if x[0] > r["ts"]]
                s["peak"] = max(s["peak"], s["equity"])
                s["dd"] = max(s["dd"], s["peak"] - s["equity"])
    return s


def same(got, s):
    assert (got["bets"], got["wins"]) == (s["bets"], s["wins"]) and s["bets"] > 3
    assert [got[k] for k in ("cash", "equity", "pnl", "drawdown")] == pytest.approx([s["cash"], s["equity"], s["pnl"], s["dd"]])


def test_signal_replay(spark):
    p = simulate.SignalParams(bank=500.0, most=100.0, share=0.2)
    rows = [r.asDict() for r in extended._signal_rows(spark, SF).collect()]
    done = set()

    def act(r, s):
        if abs(r["signal"]) > 10 and 0.05 < r["price"] < 0.95 and r["market"] not in done:
            stake = min(100.0, 0.2 * s["equity"])
            if s["cash"] > stake:
                right = (r["outcome"] > 0) == (r["signal"] > 0)
                slip = 0.2 * stake / 100
                if (r["outcome"] > 0) == r["is_yes"]:
                    paid = r["price"] * (1 + slip)
                    profit = (1 - paid) * stake / paid
                else:
                    paid = r["price"] * (1 - slip)
                    profit = paid * stake / (1 - paid)
                s["open"].append((r["end"], profit if right else -stake, stake))
                s["cash"] -= stake
                s["bets"] += 1
                s["wins"] += right
                done.add(r["market"])

    same(extended.q44d_signal_replay(spark, SF).first(), money(act, rows, p))


def test_copy_replay(spark):
    p = simulate.SignalParams(bank=500.0, most=100.0, share=0.2)
    rows = [r.asDict() for r in extended._signal_rows(spark, SF).collect()]
    done = set()

    def act(r, s):
        if r["elite"] and r["tokens"] > 0 and 0.05 < r["price"] < 0.95 and r["market"] not in done:
            done.add(r["market"])
            stake = min(100.0, 0.2 * s["equity"])
            right = (r["outcome"] > 0) == r["is_yes"]
            paid = r["price"] * (1 + 0.2 * stake / 100 * (1 if right else -1))
            profit = (1 - paid) * stake / paid if right else paid * stake / (1 - paid)
            if profit / stake / (max((r["end"] - r["ts"]) // 86400, 1) / 365) > 5 and s["cash"] > stake:
                s["open"].append((r["end"], profit if right else -stake, stake))
                s["cash"] -= stake
                s["bets"] += 1
                s["wins"] += right

    same(extended.q44e_copy_replay(spark, SF).first(), money(act, rows, p))


def test_entry_replay(spark):
    rows = sorted((r.asDict() for r in extended._signal_rows(spark, SF).collect()), key=lambda r: (r["ts"], r["id"]))
    cash = equity = peak = 900.0
    held, seen, down, beat, n = {}, set(), 0.0, None, [0, 0, 0, 0]
    for r in rows:
        c = r["contract"]
        if r["margin"] > 0 and r["variance"] < 0.15 and r["price"] < 0.3 and not r["hostile"] and r["market"] not in seen and c not in held and cash >= 100:
            held[c] = (100 / max(0.001, min(0.99, r["price"] * 1.05)), r["end"], r["outcome"])
            cash -= 100
            seen.add(r["market"])
            n[0] += 1
        if c in held and r["price"] >= 0.9:
            gain = held.pop(c)[0] * r["price"] * 0.95
            cash, equity = cash + gain, equity + gain - 100
            n[1] += 1
            n[2 if gain > 100 else 3] += 1
        beat = r["ts"] if beat is None else beat
        if r["ts"] - beat >= 3600:
            beat = r["ts"]
            for c in [c for c in held if held[c][1] <= r["ts"]]:
                q, _, o = held.pop(c)
                cash, equity = cash + q * o, equity + q * o - 100
                n[2] += q * o > 100
                n[3] += q * o < 100
            peak = max(peak, equity)
            down = max(down, peak - equity)
    got = extended.q44f_entry_replay(spark, SF).first()
    assert [got[k] for k in ("bought", "sold", "won", "lost", "held")] == [*n, len(held)] and n[0] > 3
    assert [got[k] for k in ("cash", "equity", "drawdown")] == pytest.approx([cash, equity, down])


def test_portfolio_phases(spark):
    row = "config int, id long, ts long, contract long, market long, price double, signal boolean, priority double, outcome double, end long"
    rows = [
        (0, 1, 10, 1, 1, 0.5, True, 1.0, 1.0, 100), (0, 2, 10, 2, 2, 0.5, True, 9.0, 0.0, 40), (0, 3, 20, 3, 3, 0.4, True, 1.0, None, 50), (0, 4, 40, 4, 4, 0.25, True, 1.0, 1.0, 90),
        (0, 5, 45, 1, 1, 0.96, False, 0.0, 1.0, 100), (0, 6, 60, 5, 4, 0.2, True, 1.0, 1.0, 90), (0, 7, 95, 9, 9, 0.5, False, 0.0, None, None), (1, 8, 10, 1, 1, 0.5, True, 1.0, 1.0, 5),
    ]
    p = simulate.PortfolioParams(bank=200.0, slippage=0.0)
    got = {(r["contract"], r["entry_ts"]): (r["state"], r["exit_ts"], r["paid"]) for r in simulate.portfolio_replay(spark.createDataFrame(rows[:7], row), p).collect()}
    # 2 goes first by priority; 3 finds no cash; 2 is lost at 40, which leaves none for 4; 1 is sold at 45, and then 5 is bought, whose market is 4's
    assert got == {(1, 10): ("sold", 45, 192.0), (2, 10): ("settled", 40, 0.0), (5, 60): ("settled", 90, 500.0)}
    twice = simulate.portfolio_replay(spark.createDataFrame(rows, row), p).groupBy("config").count().collect()
    assert {r["config"]: r["count"] for r in twice} == {0: 3, 1: 1}
    held = simulate.portfolio_replay(spark.createDataFrame([(0, 1, 10, 1, 1, 0.5, True, 1.0, None, 20), (0, 2, 11, 2, 2, 0.5, True, 1.0, 1.0, 99)], row), p)
    m = spark.createDataFrame([(1, None, 20), (2, 1.0, 99)], "contract long, outcome double, end long")
    last = spark.createDataFrame([(1, 0.7)], "contract long, price double")
    done = {r["contract"]: (r["state"], r["value"], r["won"]) for r in simulate.drained(held, m, last, 99).collect()}
    assert done == {1: ("carried", pytest.approx(140.0), None), 2: ("settled", 200.0, True)}


def test_events(spark):
    row = "config int, ts long, id long, kind string, contract long, price double, volume double, sell boolean, skill double, outcome double, end long"
    rows = [
        (0, 0, 0, "NEW", 1, None, None, None, None, None, None), (0, 60, 1, "TRADE", 1, 0.5, 3000.0, False, 0.25, None, 86400 * 3), (0, 120, 2, "TRADE", 1, 0.6, 1.0, True, 0.25, None, 86400 * 3),
        (0, 180, 0, "RESOLUTION", 1, None, None, None, None, 1.0, None),
    ]
    p = simulate.EventParams(splash=1000.0, sizing="fixed", size=100.0)
    got = simulate.event_replay(spark.createDataFrame(rows, row), p).first()
    put = 100 / 1.002 * 0.97
    entry = 0.5 + put / (10_000 + put) + 0.0025
    assert got["trades"] == 1 and got["open"] == 0 and got["final_value"] == pytest.approx(10_000 - 100 + put / entry)
    stopped = simulate.event_replay(spark.createDataFrame(rows[:2] + [(0, 120, 2, "TRADE", 1, 0.2, 1.0, True, 0.25, None, 86400 * 3)], row), simulate.EventParams(splash=1000.0, sizing="fixed", size=100.0, stop_loss=0.4)).first()
    assert stopped["open"] == 0 and stopped["final_value"] == pytest.approx(9_900 + put / entry * 0.2 * 0.998 * 0.97)
    grid = extended.q45_grid_tuning(spark, SF).orderBy("place").collect()
    assert len({r["config"] for r in grid}) == 27 and all(a["score"] >= b["score"] - 1e-9 for a, b in zip(grid, grid[1:]))
    one = simulate.event_replay(extended._event_rows(spark, SF).withColumn("config", F.lit(0)), simulate.EventParams(splash=grid[0]["splash"], size=grid[0]["size"], least_edge=grid[0]["least_edge"])).first()
    assert one["final_value"] == pytest.approx(grid[0]["final_value"])


def test_models(spark):
    assert fresh.t_tail(2.0, 10) == pytest.approx(0.07338803477074039) and fresh.t_tail(0.5, 3) == pytest.approx(0.651447964848151)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    full = np.column_stack([np.ones(800), x])
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve((full * (q * (1 - q))[:, None]).T @ full, full.T @ (y - q))
    assert fresh.logit(df, "y", ["a", "b"]) == pytest.approx(beta.tolist(), abs=1e-8)
    assert fresh.logit(df.limit(20), "y", ["a", "b"]) is None
    fit = fresh.line(df, "y", "a")
    slope, intercept = np.polyfit(x[:, 0], y, 1)
    assert (fit["slope"], fit["intercept"]) == pytest.approx((slope, intercept)) and fit["p"] < 1e-6
    right = {r["won"]: r["right"] for r in extended.q10d_boosted(spark, SF).collect()}
    assert sum(right.values()) / 2 > 0.55
    n = 400
    t = [(i, float(math.expm1(i % 10)), 1.0, 1.0 if i % 100 >= 50 - 4 * (i % 10) else 0.0, 0) for i in range(n)]
    trades = spark.createDataFrame(t, "wallet long, usdc double, tokens double, outcome double, resolved_at long")
    slope, intercept = fresh.brier_line(trades)
    plain = np.polyfit([i % 10 for i in range(n)], [(1 - r[3]) ** 2 for r in t], 1)
    assert plain[0] < slope < -0.002 and 0.15 <= intercept <= 0.35
    assert fresh.brier_line(trades, before=0) == (0.0, 0.25) and fresh.brier_line(trades, known=trades) == (0.0, 0.25)


def test_shrunk_covariance(spark):
    x = np.random.default_rng(1).normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    cov, mean, intensity = features.shrunk_covariance(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    t, n = x.shape
    z = x - x.mean(0)
    s = z.T @ z / t
    sd = np.sqrt(np.diag(s))
    r = np.mean([s[i, j] / sd[i] / sd[j] for i in range(n) for j in range(n) if i != j])
    target = np.array([[s[i, i] if i == j else r * sd[i] * sd[j] for j in range(n)] for i in range(n)])
    pi = np.array([[np.mean((z[:, i] * z[:, j] - s[i, j]) ** 2) for j in range(n)] for i in range(n)])
    theta = lambda i, j: np.mean((z[:, i] ** 2 - s[i, i]) * (z[:, i] * z[:, j] - s[i, j]))
    rho = np.trace(pi) + sum(r / 2 * (sd[j] / sd[i] * theta(i, j) + sd[i] / sd[j] * theta(j, i)) for i in range(n) for j in range(n) if i != j)
    want = max(0.0, min(1.0, (pi.sum() - rho) / ((s - target) ** 2).sum() / t))
    assert (mean, intensity) == pytest.approx((r, want)) and 0 < want < 1
    assert np.allclose(cov, want * target + (1 - want) * s)


def test_linear_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(i), float(c), float(a)) for i, (k, c, a) in enumerate(zip(rng.integers(0, 3, 200), np.cumsum(rng.exponential(400, 200)), rng.normal(size=200)))]
    df = spark.createDataFrame(rows, "k int, id int, clock double, x double").repartition(4)
    got = {r["id"]: r["s"] for r in windows.decayed_sum(df, "k", ["id"], "clock", "x", 0.95, "s").collect()}
    for k, i, c, _ in rows:
        assert got[i] == pytest.approx(sum(a * 0.95 ** (c - d) for q, j, d, a in rows if q == k and j <= i), rel=1e-9, abs=1e-12)
    total = {r["id"]: r["t"] for r in windows.running_total(df, ["clock", "id"], {"t": "x"}, 7).collect()}
    assert [total[i] for i in range(200)] == pytest.approx(np.cumsum([r[3] for r in rows]).tolist())
    z = spark.range(-60, 61).select((F.col("id") / 10.0).alias("x"))
    from emberlake.functions.normalize import erf

    assert all(r[1] == pytest.approx(math.erf(r[0]), abs=1e-13) for r in z.select("x", erf(F.col("x"))).collect())


def test_snapshot_of_several_rows(spark):
    rows = [(1, "t", "book", "bid", "0.50", 5.0), (2, "t", "book", "ask", "0.6", 5.0), (3, "t", "delta", "bid", "0.5", 0.0), (4, "t", "delta", "bid", "0.4", 2.0), (5, "t", "book", "bid", "0.3", 1.0), (6, "t", "book", "ask", "0.7", 1.0)]
    m = spark.createDataFrame(rows, "seq long, token string, kind string, side string, price string, size double")
    assert [tuple(r) for r in execution.best_quotes(execution.book_state(m)).collect()] == [("t", 0.3, 0.7)]
    assert [tuple(r) for r in execution.best_quotes(execution.book_state(m.where("seq < 5"))).collect()] == [("t", 0.4, 0.6)]


def test_ledgers_without_ranges_are_incomplete(spark):
    held = spark.createDataFrame([("a", 0, 9), ("b", 2, 4)], "k string, lo long, hi long")
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: (r["missing"], r["gaps"], r["complete"]) for r in intervals.completeness(held, books, 0, 9, "k").collect()}
    assert got == {"a": (0, 0, True), "b": (7, 2, False), "c": (10, 1, False)}
    with pytest.raises(ValueError, match="c lacks 10"):
        intervals.prove_complete(held, books, 0, 9, "k")


def test_more_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "1",\n "b": "2"}')
    assert {r["key"]: r["value"] for r in tables.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {"a": "1", "b": "2"}
    db = str(tmp_path / "t.db")
    with sqlite3.connect(db) as c:
        c.execute("create table trades (k integer, name text)")
        c.executemany("insert into trades values (?, ?)", [(i // 2, f"n{i}") for i in range(25_000)])
    got = tables.read_sqlite(spark, db, "trades", "name string, k long", "k", 0, 12_400, 3)
    assert got.count() == 24_802 and got.distinct().count() == 24_802
    (tmp_path / "t.csv").write_text("id,timestamp,tradeAmount,outcomeTokensAmount,user,maker,contract_id,price,size,side_mult\na,1,2.0,3.0,u,m,7,0.5,3.0,1\nb,1,zero,3.0,u,m,7,0.5,3.0,1\n")
    rows = {r["id"]: r["_corrupt_record"] for r in tables.read_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert rows["a"] is None and "zero" in rows["b"]
    coo = spark.createDataFrame([("x", "p", 1.0), ("y", "p", 2.0), ("y", "q", 3.0)], "a string, b string, v double")
    tables.write_coo(frames.entity_index(coo, "a", "b", "v"), str(tmp_path / "coo"))
    back = tables.read_coo(spark, str(tmp_path / "coo")).collect()
    assert {r["row"] for r in back} == {0, 1} and {r["col"] for r in back} == {0, 1} and sum(r["value"] for r in back) == 6
    assert tables.cache_path("f", "n", a=1, b="x") == tables.cache_path("f", "n", b="x", a=1) != tables.cache_path("f", "n", a=2, b="x")
    calls = []
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or coo).count() == 3
    assert len(calls) == 1
    tables.write_weeks(spark.createDataFrame([(1704067200, 1), (1704067200 + 8 * 86400, 2)], "ts long, v int"), str(tmp_path / "w"), "ts")
    assert {r["week"].isoformat() for r in spark.read.parquet(str(tmp_path / "w")).select("week").collect()} == {"2024-01-01", "2024-01-08"}
    each = tables.accumulate_batch(spark, str(tmp_path / "sums"), ["a"], ["v"])
    each(coo.select("a", "v"), 0)
    each(coo.select("a", "v"), 1)
    each(coo.select("a", "v"), 1)  # run again after a failure
    assert {r["a"]: r["v"] for r in tables.latest_version(spark, str(tmp_path / "sums")).collect()} == {"x": 2.0, "y": 10.0}
    target = str(tmp_path / "swap")
    tables.write_parquet(coo, target)
    tables.replace_atomically(spark, coo.limit(1), target)
    import os

    os.rename(target, target + ".gone")  # as after a crash between the renames
    tables.recover(spark, target)
    assert spark.read.parquet(target).count() == 3


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two runs over files that come between them give the rows of one run over both."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    schema, out = e.schema, []

    def run():
        df = streams.decayed_weight(streams.events_stream(spark, str(tmp_path / "in"), schema))
        streams.run_available(df, "", str(tmp_path / "cp"), "update", lambda frame, _: out.extend(frame.collect()))

    e.where("event_id < 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    first = len(out)
    e.where("event_id >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    from emberlake.plans import catalog

    last = {r["user_id"]: r for r in out}
    whole = {r["user_id"]: r for r in catalog.QUERIES["s5_decay_stream"](spark, SF).collect()}
    assert first and len(out) > first and last.keys() == whole.keys()
    grown = [u for u in whole if last[u]["n"] == whole[u]["n"]]
    assert grown and all(last[u]["weight"] == pytest.approx(whole[u]["weight"], abs=1e-3) for u in grown)
