"""The driver's tables seen as trades, markets and ticks, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions.normalize import micros, seconds
from emberlake.session import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills: wallet, contract_id, price (0..1), tokens (negative if sold), usdc, ts. The two tables are joined on the order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    price = F.col("l_discount") * 10
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("wallet"), F.col("l_partkey").alias("contract_id"), price.alias("price"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("tokens"),
        (price * F.col("l_quantity")).alias("usdc"), seconds(F.col("l_shipdate")).alias("ts"), F.col("l_orderkey").alias("order_id"),
    )


TRADES = """trades AS (
  SELECT o_custkey AS wallet, l_partkey AS contract_id, l_discount * 10 AS price,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS tokens,
         l_discount * 10 * l_quantity AS usdc, CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_orderkey AS order_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens per market: contract_id, market_id, token_index, outcome (1, 0, 0.5 void, null open), question, kind, resolved_at."""
    size, key = F.col("p_size"), F.col("p_partkey")
    outcome = F.when(size == 50, 0.5).when(size == 49, F.lit(None)).otherwise((size % 2).cast("double"))
    return table(spark, sf_dir, "part").select(
        key.alias("contract_id"), F.floor(key / 2).alias("market_id"), (key % 2).cast("int").alias("token_index"), outcome.alias("outcome"),
        F.col("p_name").alias("question"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"),
        (F.lit(1_000_000_000) + key * 3600).alias("resolved_at"), (F.lit(800_000_000) + key * 3600).alias("started_at"), F.col("p_retailprice").alias("liquidity"),
    )


MARKETS = """markets AS (
  SELECT p_partkey AS contract_id, CAST(floor(p_partkey / 2) AS BIGINT) AS market_id, CAST(p_partkey % 2 AS INTEGER) AS token_index,
         CASE WHEN p_size = 50 THEN 0.5::DOUBLE WHEN p_size = 49 THEN NULL ELSE (p_size % 2)::DOUBLE END AS outcome,
         p_name AS question, p_type AS kind, p_brand AS brand, 1000000000 + p_partkey * 3600 AS resolved_at, 800000000 + p_partkey * 3600 AS started_at, p_retailprice AS liquidity
  FROM part)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique, ordered fills: id, ts (seconds), us (microseconds), wallet, contract, usdc, price, side (+1/-1), props."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), seconds(F.col("ts")).alias("ts"), micros(F.col("ts")).alias("us"), F.col("user_id").alias("wallet"),
        F.col("event_type").alias("contract"), F.col("value").alias("usdc"), (((F.col("event_id") * 37) % 99 + 1) / 100.0).cast("double").alias("price"),
        F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("side"), F.col("props"),
    )


TICKS = """ticks AS (
  SELECT event_id AS id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, epoch_us(ts) AS us, user_id AS wallet, event_type AS contract, value AS usdc,
         (((event_id * 37) % 99 + 1) / 100.0)::DOUBLE AS price, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS side, props
  FROM events)"""


def register(spark: SparkSession, sf_dir: str) -> None:
    """Makes trades, markets, ticks and the tables themselves temporary views, for ``spark.sql``; nothing is read until a query asks for it."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, made in (("trades", trades), ("markets", markets), ("ticks", ticks)):
        made(spark, sf_dir).createOrReplaceTempView(name)
