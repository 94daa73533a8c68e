"""Analogues of the domain's inputs in the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(column: str):
    """Seconds since 1970 of a timestamp without time zone, rounded down."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})") / 1000000).cast("long")


def events(spark: SparkSession, sf_dir: str, length: int = 3600) -> DataFrame:
    """Events as intervals [s, s + length)."""
    return read(spark, sf_dir, "events").withColumn("s", epoch_seconds("ts")).withColumn("e", F.col("s") + length)


def events_sql(length: int = 3600) -> str:
    return f"(SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + {length} AS e FROM events)"


def days(column: str):
    return F.floor(epoch_seconds(column) / 86400).cast("long")


def days_sql(column: str) -> str:
    return f"CAST(floor(epoch_us({column}) / 86400000000) AS BIGINT)"


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as day intervals [d, d + quantity)."""
    return read(spark, sf_dir, "lineitem").withColumn("d", days("l_shipdate")).withColumn("f", F.col("d") + F.col("l_quantity").cast("long"))


SHIPMENTS_SQL = f"(SELECT *, {days_sql('l_shipdate')} AS d, {days_sql('l_shipdate')} + CAST(l_quantity AS BIGINT) AS f FROM lineitem)"
