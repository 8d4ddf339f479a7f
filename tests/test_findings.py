"""Cases of a review: small tables made so that the query would go wrong, against DuckDB or plain Python."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from emberlake.operators import bayes, features, positions, simulate
from emberlake.plans import catalog, extended

START = datetime.datetime(2024, 1, 1)


def events(path, rows):
    """rows: seconds after START, user, type, value; the place is the id."""
    at = [None if s is None else START + datetime.timedelta(microseconds=round(s * 1_000_000)) for s, *_ in rows]
    pq.write_table(pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([r[1] for r in rows], pa.int64()),
        "event_type": pa.array([r[2] for r in rows], pa.string()), "value": pa.array([r[3] for r in rows], pa.float64()), "props": pa.array(["{}"] * len(rows)),
    }), f"{path}/events.parquet")


def parity(spark, path, name, tables=("events",)):
    """Rows of the query, which must be its SQL's."""
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    cur = c.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in columns]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(path)).select(*columns).collect()), key=repr)
    assert got == want
    return got


def test_sliding_stream_takes_the_nearest_second(spark, tmp_path):
    six = 21600
    late = [0, 1 * six - 0.5, 2 * six - 0.3, 3 * six - 0.6, 4 * six + 0.3, 5 * six - 0.000001, 9 * six]
    events(tmp_path, [(s, 1, "view", 1.0 + i) for i, s in enumerate(late)])
    assert parity(spark, tmp_path, "s2_sliding_stream")


@pytest.mark.parametrize("last", [1800 - 0.3, 1800.0, 1800.3])
def test_sliding_stream_closes_by_exact_times(spark, tmp_path, last):
    events(tmp_path, [(s, 1, "view", 1.0) for s in (0, 21600 - 0.4, 8 * 21600 + last)])
    assert parity(spark, tmp_path, "s2_sliding_stream")


@pytest.mark.parametrize("name", ["q44d_signal_replay", "q44e_copy_replay", "q44f_entry_replay"])
def test_replays_take_rows_without_money(spark, tmp_path, name):
    rnd = random.Random(4)
    events(tmp_path, [(i * 1800, rnd.randrange(60), rnd.choice("ab"), rnd.choice([0.0, 0.0, 3.0, 90.0])) for i in range(300)])
    assert catalog.QUERIES[name](spark, str(tmp_path)).first()["config"] == 0
    signal = {r["value"]: r["n"] for r in extended._signal_rows(spark, str(tmp_path)).selectExpr("margin = -1 as value", "signal").groupBy("value").agg({"signal": "count"}).withColumnRenamed("count(signal)", "n").collect()}
    assert signal[True] == 0 and signal[False] > 0
    assert simulate.signal_replay(extended._signal_rows(spark, str(tmp_path))).count() == 1


def test_quality_does_not_hang_on_the_order_of_rows(spark):
    """Gains of just 50 in sum, of which one order adds up to more and another to less."""
    rnd, gains, orders = random.Random(7), [0.1, 0.2, 0.3, 0.7, 1.1, 2.3, 5.7, 39.6], {}
    while len(orders) < 2:
        rnd.shuffle(gains)
        total = 0.0
        for g in gains:
            total += g
        if total != 50:
            orders.setdefault(total > 50, list(gains))
    rows = [(wallet, 1, -1.0, g) for wallet, own in ((1, orders[True]), (2, orders[False]), (3, [*orders[True], 0.001])) for g in own]
    trades = spark.createDataFrame(rows, "wallet long, contract_id long, tokens double, usdc double").coalesce(1)
    markets = spark.createDataFrame([(1, 0.0)], "contract_id long, outcome double")
    assert [r["wallet"] for r in positions.wallet_quality(trades, markets).collect()] == [3]


def test_path_features_leave_out_rows_without_time_or_contract(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(None if rnd.random() < 0.1 else rnd.randrange(0, 300_000, 1200), 1, rnd.choice(["a", "b", None]), 1.0) for _ in range(400)]
    events(tmp_path, [*rows, *((s, 1, "c", 1.0) for s in (0, 3600, 86400, 86401, 172800, 172801, 400_000))])
    assert len(parity(spark, tmp_path, "q33_q34_path_features")) == 407
    # a frame with two moving ends is summed anew for every row
    assert "RangeFrame, -" not in catalog.QUERIES["q33_q34_path_features"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 3, 500])
def test_co_members_by_classes(spark, block):
    rnd = random.Random(3)
    edges = [(a, v) for a in range(40) for v in rnd.choice(["xy", "xyz", "z", "w", "vwx"])] + [(None, "x"), (50, None), (1, "x"), (1, "x")]
    by = {}
    for a, v in edges:
        by.setdefault(a, set()).add(v)
    own = {a: v - {None} for a, v in by.items() if a is not None}
    want = sorted((a, b, len(own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b])
    got = features.co_members(spark.createDataFrame(edges, "m long, v string"), "m", "v", block).collect()
    assert sorted(map(tuple, got)) == want


def test_scan_copies_trades_for_few_buckets_and_misses_none(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(3), rnd.random() < 0.5, rnd.choice([0, 100, 101, 200, 201, 500, 1000, rnd.randrange(1001)]), rnd.choice([0, 604, 605, 1208, 1209, rnd.randrange(4000)]), rnd.randrange(5), rnd.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, wallet long, yes boolean, price_int int, log_ttr int, day int, win boolean")
    assert bayes._copies(df).count() <= 8 * len(rows)
    want = {}
    for i, w, yes, p, t, day, _ in rows:
        for side, at in ((yes, p), (not yes, 1000 - p)):
            n = sum(r[1] == w and r[2] == side and r[5] < day and abs(r[3] - at) <= 100 and abs(r[4] - t) <= 604 for r in rows)
            want[i] = want.get(i, 0) + n
    assert {r["id"]: r["entries"] for r in bayes.scan(df, df).collect()} == {i: n for i, n in want.items() if n}
