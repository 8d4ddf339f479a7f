"""Readers and sinks. Schemas are stated, never inferred, where data is large."""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TRADES = "id string, timestamp string, tradeAmount double, outcomeTokensAmount double, user string, maker string, contract_id string, price double, size double, side_mult int"
AUDIT = "ts double, side string, token string, price double, qty double, equity double, pnl double, _corrupt_record string"


def read_parquet(spark: SparkSession, *paths: str, drift: bool = False) -> DataFrame:
    """drift: files whose schemas differ are merged by name."""
    return spark.read.option("mergeSchema", str(drift).lower()).parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | StructType = TRADES, tolerant: bool = True) -> DataFrame:
    """tolerant: bad lines come back whole in ``_corrupt_record`` (null for good ones), with what of them could be read; else they fail the read."""
    if not tolerant:
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    stated = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = StructType([*stated.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(with_bad).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of JSON files that each hold one object: a map from names to values of the stated type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, key: str, low: int, high: int, parts: int = 8) -> DataFrame:
    """The rows of an SQLite file with key from ``low`` to ``high``, a key range a task, each read page by page in order of the key. The file must lie where all
    executors see it. schema: names and types, in the order of the columns that are read."""
    names = StructType.fromDDL(schema).names
    step = max(1, -(-(high - low + 1) // parts))

    def read(batches):
        import sqlite3

        kinds = [f.type for f in empty]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                at, end = low + part * step, min(high, low + (part + 1) * step - 1)
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
                    while True:
                        got = c.execute(f'select {", ".join(names)}, {key} from {table} where {key} >= ? and {key} <= ? order by {key} limit 10000', (at, end)).fetchall()
                        if not got:
                            break
                        full = got[:-1] if len(got) == 10000 and got[0][-1] != got[-1][-1] else got
                        last = full[-1][-1]
                        rows = [r for r in full if r[-1] != last] + c.execute(f'select {", ".join(names)}, {key} from {table} where {key} = ?', (last,)).fetchall()
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                        at = last + 1

    import pyarrow as pa

    empty = spark.createDataFrame([], schema).toArrow().schema
    return spark.range(0, parts, 1, parts).mapInArrow(read, schema)


def write_coo(df: DataFrame, path: str) -> None:
    """Coordinates (row, col, value) of a sparse matrix, sorted by row within files; its shape is one more than the largest of each."""
    df.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double")).repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, col long, value double").parquet(path)


def cache_path(folder: str, name: str, **settings) -> str:
    """Where the result of a step under these settings is kept: the same settings, in any order, give the same path."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    return f"{folder.rstrip('/')}/{name}-{digest[:16]}"


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made by ``make()`` if it is not there whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_weeks(df: DataFrame, path: str, at: str) -> None:
    """Event files by the Monday (UTC) of their week; ``at`` holds seconds."""
    monday = F.date_format(F.date_trunc("week", F.timestamp_seconds(at)), "yyyy-MM-dd")
    overwrite_days(df.withColumn("week", monday), path, "week")


def read_jsonl(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """Bad lines come back in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table by key ranges, one query per part. Needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null, others are left out."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def require(df: DataFrame, *columns: str) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def write_parquet(df: DataFrame, path: str, *by: str, codec: str = "zstd") -> None:
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replaces only the days that df holds, so a run can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def replace_atomically(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes beside the table that may be read by df, then swaps; the old one stays as .bak until the next time.

    A reader sees the old table or the new one, but for the instant between two renames; what a crash there leaves is put right by ``recover``,
    which this calls first, so at every moment either the table or its .bak is whole."""
    recover(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.bak"
    df.write.parquet(new)
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    spare = at(f"{path}.{uuid.uuid4().hex}.old")
    if fs.exists(at(old)):
        fs.rename(at(old), spare)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(spare, True)


def recover(spark: SparkSession, path: str) -> None:
    """Puts the .bak back where the table is missing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.bak")):
        fs.rename(at(f"{path}.bak"), at(path))


def add_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming whose key is new, once each."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def accumulate(existing: DataFrame, incoming: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds the sums of incoming rows to the stored ones."""
    return existing.select(*keys, *sums).unionByName(incoming.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def accumulate_batch(spark: SparkSession, path: str, keys: list[str], sums: list[str]):
    """For ``foreachBatch``: adds a micro-batch to the sums stored below path. Each batch writes a new version, named by its number, so one that is
    run again after a failure changes nothing twice; ``latest_version`` reads the newest whole one."""

    def each(frame: DataFrame, batch_id: int) -> None:
        before = latest_version(spark, path, batch_id)
        new = frame.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        (new if before is None else accumulate(before, new, keys, sums)).write.mode("overwrite").parquet(f"{path}/v{batch_id:012d}")

    return each


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    whole = [v for v in sorted(found) if v[:1] == "v" and (before is None or int(v[1:]) < before) and fs.exists(at(f"{path}/{v}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{whole[-1]}") if whole else None


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_ranking_csv(df: DataFrame, path: str, *order) -> None:
    """One sorted file of a result that is small by nature."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
