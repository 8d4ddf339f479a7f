"""Session settings shared by all queries."""

from __future__ import annotations

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Pins the zone (the tables' timestamps carry none) and leaves sizing to adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark
