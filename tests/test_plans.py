"""What the physical plans must and must not hold."""

import pytest

import __spark_entry__ as entry
from emberlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q14_signal_decay", "q12_percentile", "q46_graph_features", "q50_cosine_neighbours", "q33_q34_path_features", "q39c_implied_liquidity", "q35_match_flow", "q54_bayes_posterior"])
def test_no_join_of_all_rows_with_all(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_decay_compares_no_rows_with_each_other(spark):
    """One join, of rows with the carry of their slot."""
    p = plan(catalog.QUERIES["q14_signal_decay"](spark, SF))
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") + p.count("ShuffledHashJoin") <= 1


def test_scans_read_the_columns_they_need(spark):
    p = plan(catalog.QUERIES["q01_leaderboard"](spark, SF))
    assert "l_comment" not in p and "l_extendedprice" not in p and "o_totalprice" not in p


def test_whole_catalogue_is_offered():
    names = entry.queries()
    assert set(catalog.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
