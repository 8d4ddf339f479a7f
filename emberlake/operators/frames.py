"""Small table operations: renaming, nulls, order, samples, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.windows import running_total


def rename_present(df: DataFrame, names: dict[str, str], only: bool = False) -> DataFrame:
    """Renames the columns that are there, in the map's order with ``only``, which leaves out all others."""
    have = {a: b for a, b in names.items() if a in df.columns}
    return df.select(*(F.col(a).alias(b) for a, b in have.items())) if only else df.withColumnsRenamed(have)


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value, that is neither null nor not-a-number, in each of the columns (all, if none is named) that the table has."""
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    return df.dropna(subset=wanted) if wanted else df


def without_zero_times(df: DataFrame, at: str = "timestamp") -> DataFrame:
    """Rows whose time was never filled in go; null times stay."""
    return df.where(F.coalesce(F.col(at) != 0, F.lit(True)))


def repair_times(rows: DataFrame, found: DataFrame, key: str = "id", at: str = "timestamp") -> DataFrame:
    """rows with the times of ``found`` (key, at) in place of theirs where there is one; of several the largest."""
    new = found.groupBy(key).agg(F.max(at).alias("_new"))
    return rows.join(new, key, "left").withColumn(at, F.coalesce("_new", at)).drop("_new").select(*rows.columns)


def inserts(messages: DataFrame, op: str = "op") -> DataFrame:
    """Of webhook messages those that add a row."""
    return messages.where(F.col(op) == "INSERT")


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """name, n, mean, sd, least, q25, q50, q75, most of numeric columns, in one pass (exact quartiles, interpolated)."""
    s = df.agg(*(F.struct(
        F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("least"),
        F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).cast("double").alias("most"),
    ).alias(c) for c in columns))
    x = s.select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    return x.select("name", "n", "mean", "sd", "least", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))), "most")


def nearest_quantile(column: str, share: float) -> Column:
    """The value at the place nearest to share * (n - 1) in order (halves go up): none in between."""
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, (F.floor(share * (F.count(column) - 1) + 0.5) + 1).cast("int"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values with their number and share, null as a value of its own."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(df.agg(F.count("*").alias("_all"))), F.lit(True)).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))


def top_per(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group in the given order, which should have no ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by the hash of their key: the same ones whatever the order or partitioning of the table."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def ordered_once(df: DataFrame, *order: str) -> DataFrame:
    """Equal rows once, in the total order of the named columns and, within ties, of all others."""
    return df.distinct().orderBy(*order, *(c for c in df.columns if c not in order))


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def entity_index(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Coordinates of a sparse matrix: row, col (from 0, in order of the names' hashes) and value of each pair, as ``sources.tables.write_coo`` stores it."""

    def place(c: str, n: str) -> DataFrame:
        names = pairs.select(c).distinct().withColumns({"_h": F.xxhash64(c), "_one": F.lit(1)})
        return running_total(names, ["_h", c], {n: "_one"}).select(c, (F.col(n) - 1).alias(n))

    total = pairs.groupBy(a, b).agg(F.sum(weight).alias("value"))
    return total.join(place(a, "row"), a).join(place(b, "col"), b).select("row", "col", "value")
