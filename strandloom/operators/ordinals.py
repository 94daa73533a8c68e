"""Global order without a single-partition window.

Rows are dealt to quantile ranges of the leading order column by a formula of the value, so the
deal does not hang on any physical partitioning; each range is ordered by itself and shifted by
what lies before it. Only one row a range is ever windowed globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_range(df: DataFrame, column: str, parts: int, out: str = "_range") -> DataFrame:
    """Deal the rows to at most ``parts`` ranges of a numeric column; equal values meet, nulls in the first."""
    bounds = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    where = F.lit(0)
    for b in bounds:
        where = where + F.coalesce(F.col(column) > F.lit(b), F.lit(False)).cast("int")
    return df.withColumn(out, where)


def _before(ranges: DataFrame, value: str) -> DataFrame:
    return ranges.select("_range", F.coalesce(F.sum(value).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def running_total(df: DataFrame, column: str, value: str, *, parts: int = 16, out: str = "upto") -> DataFrame:
    """Sum of ``value`` over the rows up to each one in the order of ``column``, whose values are distinct."""
    dealt = quantile_range(df, column, parts)
    sizes = dealt.groupBy("_range").agg(F.sum(value).alias("_n"))
    local = F.sum(value).over(Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_local", local).join(F.broadcast(_before(sizes, "_n")), "_range").withColumn(out, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def global_row_number(df: DataFrame, column: str, order: list[Column | str], *, parts: int = 16, out: str = "ordinal") -> DataFrame:
    """Row numbers from 1 in the order (column, *order); nulls come first. The rows of one value are ordered by one task."""
    dealt = quantile_range(df, column, parts)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(column, *order))
    return dealt.withColumn("_local", local).join(F.broadcast(_before(sizes, "_n")), "_range").withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_range", "_local", "_before")


def global_dense_rank(df: DataFrame, column: str, *, parts: int = 16, out: str = "ordinal") -> DataFrame:
    """Dense ranks from 1 of a numeric column; nulls come first. Only distinct values are ranked."""
    values = global_row_number(df.select(column).distinct(), column, [], parts=parts, out="_rank").select(F.col(column).alias("_value"), "_rank")
    return df.join(values, df[column].eqNullSafe(values["_value"])).withColumn(out, F.col("_rank")).drop("_value", "_rank")
