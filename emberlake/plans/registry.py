"""Registry of queries: name to Spark function and, where SQL expresses it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(**columns):
    """Columns rounded to six digits, for comparison with another engine's floating point."""
    from pyspark.sql import functions as F

    return [F.round(c, 6).alias(n) for n, c in columns.items()]
