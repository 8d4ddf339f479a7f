import numpy as np
import pandas as pd
import pytest

from emberlake.operators import bayes, execution, intervals, performance
from emberlake.sources import tables


def test_intervals_cover_the_same_points(spark):
    rng = np.random.default_rng(3)
    spans = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 300, 40), rng.integers(0, 9, 40))]
    df = spark.createDataFrame(spans, "lo long, hi long")
    inside = {x for a, b in spans for x in range(a, b + 1)}
    merged = [tuple(r) for r in intervals.merge(df).collect()]
    assert {x for a, b in merged for x in range(a, b + 1)} == inside
    gaps = [tuple(r) for r in intervals.gaps(df, 0, 320).collect()]
    assert sorted(x for a, b in gaps for x in range(a, b + 1)) == sorted(set(range(321)) - inside)


def test_empty_ledger_has_no_merged_rows(spark):
    assert intervals.merge(spark.createDataFrame([], "lo long, hi long")).count() == 0


def test_scan_with_buckets_equals_scan_without(spark):
    rng = np.random.default_rng(5)
    n = 300
    h = pd.DataFrame({"id": range(n), "wallet": rng.integers(0, 5, n), "yes": rng.integers(0, 2, n) > 0, "price_int": rng.integers(0, 1001, n), "log_ttr": rng.integers(0, 3000, n), "win": rng.integers(0, 2, n) > 0, "day": rng.integers(0, 9, n)})
    df = spark.createDataFrame(h)
    got = {r["id"]: (r["n"], r["w"]) for r in bayes.scan(df, df).collect()}
    for t in h.itertuples():
        total = hits = 0.0
        for x in h.itertuples():
            own = x.yes == t.yes
            p = t.price_int if own else 1000 - t.price_int
            if x.wallet == t.wallet and x.day < t.day and abs(x.price_int - p) <= 100 and abs(x.log_ttr - t.log_ttr) <= 604:
                w = 0.5 ** (abs(x.price_int - p) / 25) * 0.5 ** (abs(x.log_ttr - t.log_ttr) / 91)
                total, hits = total + w, hits + w * (x.win == own)
        assert got.get(t.id, (0, 0)) == pytest.approx((total, hits))


def test_positions_with_sales(spark):
    f = spark.createDataFrame([(1, "c", 1, 1, 1, 100.0, 0.5), (1, "c", 2, 2, 1, 100.0, 0.6), (1, "c", 3, 3, -1, 50.0, 0.7), (1, "c", 4, 4, -1, 900.0, 0.3)], "wallet long, contract string, ts long, id long, side int, qty double, price double")
    r = execution.positions_with_sales(f.where("id <= 2")).first()
    assert (r["qty"], r["avg_cost"]) == pytest.approx((200.0, 0.55))
    r = execution.positions_with_sales(f).first()
    assert (r["qty"], r["realised"]) == pytest.approx((0.0, 50 * 0.15 - 150 * 0.25))


def test_folds_keep_the_embargo():
    for a, b, c, d in performance.folds(0, 100, 30, 2, 10):
        assert b - a == 30 and c - b == 2 and c < d <= 100


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("id,timestamp,tradeAmount,outcomeTokensAmount,user,maker,contract_id,price,size,side_mult\na,1,2.0,3.0,u,m,7,0.5,3.0,1\nbad\n")
    assert tables.read_csv(spark, path).where("id = 'a'").count() == 1
    with open(tmp_path / "a.jsonl", "w") as f:
        f.write('{"ts": 1.0, "side": "BUY"}\nnot json\n')
    assert sum(r["_corrupt_record"] is not None for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == 1
    old, new = spark.createDataFrame([(1, 2)], "k int, n int"), spark.createDataFrame([(1, 3), (2, 4), (2, 4)], "k int, n int")
    assert [tuple(r) for r in tables.add_new(old, new, "k").collect()] == [(2, 4)]
    assert sorted(map(tuple, tables.accumulate(old, new, ["k"], ["n"]).collect())) == [(1, 5), (2, 8)]
    target = str(tmp_path / "table")
    tables.write_parquet(old, target)
    tables.replace_atomically(spark, spark.read.parquet(target).union(new), target)
    assert spark.read.parquet(target).count() == 4
    with pytest.raises(ValueError):
        tables.require(old, "missing")
    assert tables.conform(old, spark.createDataFrame([], "n long, z string").schema).dtypes == [("n", "bigint"), ("z", "string")]
    days = str(tmp_path / "days")
    tables.overwrite_days(old, days, "k")
    tables.overwrite_days(new.where("k = 2"), days, "k")
    assert spark.read.parquet(days).count() == 3
