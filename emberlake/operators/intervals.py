"""Interval and set algebra over ledgers of block ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, *keys: str) -> DataFrame:
    """Touching and overlapping [lo, hi] become one; keys: ledgers kept apart."""
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("lo") > F.max("hi").over(before) + 1).cast("int")
    x = ranges.where("lo <= hi").withColumn("new", F.coalesce(new, F.lit(1))).withColumn("island", F.sum("new").over(upto))
    return x.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def gaps(ranges: DataFrame, floor: int, head: int, *keys: str) -> DataFrame:
    """Parts of [floor, head] that no range covers."""
    m = merge(ranges, *keys)
    w = Window.partitionBy(*keys).orderBy("lo")
    inner = m.select(*keys, (F.coalesce(F.lag("hi").over(w), F.lit(floor - 1)) + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    tail = m.groupBy(*keys).agg((F.max("hi") + 1).alias("lo")).select(*keys, "lo", F.lit(head).cast("long").alias("hi"))
    out = inner.unionByName(tail).select(*keys, F.greatest("lo", F.lit(floor)).alias("lo"), F.least("hi", F.lit(head)).alias("hi"))
    return out.where("lo <= hi")


def completeness(ranges: DataFrame, ledgers: DataFrame, floor: int, head: int, key: str) -> DataFrame:
    """For every ledger (also one without ranges): numbers of [floor, head] that are missing, gaps, and whether it is complete."""
    bare = ledgers.select(key).distinct()
    held = ranges.where((F.col("hi") >= floor) & (F.col("lo") <= head))
    none = bare.join(held.select(key), key, "left_anti").select(key, F.lit(floor).cast("long").alias("lo"), F.lit(head).cast("long").alias("hi"))
    holes = gaps(held, floor, head, key).select(key, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).unionByName(none)
    g = holes.groupBy(key).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("missing"), F.count("*").alias("gaps"))
    x = bare.join(g, key, "left").withColumns({"missing": F.coalesce("missing", F.lit(0)), "gaps": F.coalesce("gaps", F.lit(0))})
    return x.withColumn("complete", F.col("gaps") == 0)


def prove_complete(ranges: DataFrame, ledgers: DataFrame, floor: int, head: int, key: str) -> None:
    """Raises if any ledger lacks a number of [floor, head]; names the first ten."""
    lacking = completeness(ranges, ledgers, floor, head, key).where("not complete").orderBy(key).limit(10).collect()
    if lacking:
        raise ValueError("incomplete: " + ", ".join(f"{r[key]} lacks {r['missing']} in {r['gaps']} gaps" for r in lacking))


def missing_ids(ids: DataFrame, column: str) -> DataFrame:
    """Whole numbers between the least and the largest id that do not occur."""
    lo, hi = ids.agg(F.min(column), F.max(column)).first()
    spark = ids.sparkSession
    return spark.range(lo or 0, (hi if hi is not None else -1) + 1).withColumnRenamed("id", column).join(ids.select(F.col(column).cast("long")), column, "left_anti")


def newest_union(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Union by name; the newest row of each key stays, rows of ``new`` before rows of ``old``."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), "_age")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_age")
