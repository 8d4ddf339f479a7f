"""Connected components of an edge table, without taking edges or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: a long, b long. One row per node: id, comp (the smallest id reachable).

    Each round takes the least label of the neighbours (pre-aggregated, so a hub is no hot group) and then the
    label of the label; it ends when no label changes, after about the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.write(both, f"{name}-edges")
    first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    labels = scratch.write(first, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("step"))
        up = labels.select(F.col("id").alias("step"), F.col("comp").alias("above"))
        jumped = least.join(up, "step", "left").select("id", "was", F.least("step", F.coalesce("above", "step")).alias("comp"))
        new = scratch.write(jumped, f"{name}-{turn}")
        done = not new.where("was <> comp").take(1)
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("id", "comp")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
