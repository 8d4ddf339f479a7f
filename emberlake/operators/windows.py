"""Running and decayed sums that are linear in the rows and leave no order of all rows to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[str], sums: dict[str, str], slices: int = 200) -> DataFrame:
    """df with, for each name of ``sums``, the sum of that column over this and all earlier rows in one order of everything.

    Rows are cut into slices of the first order column at ``slices`` approximate quantiles (those come to the driver, whatever
    the size of df); each slice is summed by itself and starts from the total of the slices before it. ``order`` must be unique."""
    first = order[0]
    cuts = sorted(set(df.where(F.col(first).isNotNull()).approxQuantile(first, [i / slices for i in range(1, slices)], 0.25 / slices)))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    x = df.withColumn("_slice", at)
    totals = x.groupBy("_slice").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))  # at most ``slices`` rows
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_slice", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    w = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = x.join(F.broadcast(base), "_slice").withColumns({n: F.col(f"_b{i}") + F.sum(c).over(w) for i, (n, c) in enumerate(sums.items())})
    return summed.drop("_slice", *(f"_b{i}" for i in range(len(sums))))


def decayed_sum(df: DataFrame, key: str, order: list[str], clock: str, add: str, base: float, name: str) -> DataFrame:
    """df with the sum over this and the key's earlier rows of add * base ** (clock now - clock then); clock never falls.

    Exact and linear: within a slot of the clock, running sums are scaled to its start (a slot is as long as a double can hold the
    scale); what earlier slots leave is carried from slot to slot, one row each."""
    width = math.floor(150 * math.log(10) / -math.log(base))
    x = df.withColumn("_slot", F.floor(F.col(clock) / width)).withColumn("_age", F.col(clock) - F.col("_slot") * width)
    w = Window.partitionBy(key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.col(add) * F.pow(F.lit(base), -F.col("_age"))).over(w)
    ends = x.groupBy(key, "_slot").agg(F.sum(F.col(add) * F.pow(F.lit(base), width - F.col("_age"))).alias("_left"))
    slots = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_slot", "_left"))).alias("_all"))  # one entry a slot

    # value: what is left at a slot's end; start: what earlier slots leave at its start
    start = F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("value"), F.lit(0.0).alias("start"))
    fold = F.aggregate("_all", F.array(start), lambda acc, s: F.concat(acc, F.array(_carried(acc, s, base, width))))
    carried = slots.select(key, F.explode(F.filter(fold, lambda c: c["slot"] >= 0)).alias("_c")).select(key, F.col("_c.slot").alias("_slot"), F.col("_c.start").alias("_start"))
    joined = x.withColumn("_own", own).join(carried, [key, "_slot"])
    return joined.withColumn(name, F.pow(F.lit(base), F.col("_age")) * (F.col("_own") + F.col("_start"))).drop("_slot", "_age", "_own", "_start")


def _carried(acc: Column, s: Column, base: float, width: int) -> Column:
    last = F.element_at(acc, -1)
    faded = last["value"] * F.pow(F.lit(base), ((s["_slot"] - last["slot"] - 1) * width).cast("double"))
    return F.struct(s["_slot"].alias("slot"), (faded * F.pow(F.lit(base), F.lit(float(width))) + s["_left"]).alias("value"), faded.alias("start"))
