"""Rank statistics and multiple-testing adjustment, distributed over value counts and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import quantile_range, running_total


def average_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, value, n, avg_rank): ties share the mean of their ranks. Works on distinct values, so a long column folds first."""
    keys = keys or []
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        counted = counted.withColumn("_upto", F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        counted = running_total(counted, value, "n", out="_upto")
    return counted.withColumn("avg_rank", (F.col("_upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).cast("double")).drop("_upto")


def tie_correction(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """1 - sum(t^3 - t) / (n^3 - n) of each key; 1 for a single value."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    n = F.sum("t")
    return counted.groupBy(*keys).agg(F.when(n > 1, 1.0 - F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")) / (n * n * n - n)).otherwise(1.0).alias("correction"))


def rank_sum_z(df: DataFrame, keys: list[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """Wilcoxon rank-sum z of ``first`` against ``second`` within keys: tie-corrected variance, continuity towards zero."""
    counted = df.where(F.col(group).isin(first, second)).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("n"))
    return rank_sum_z_of_counts(counted, keys, group, first, value, "n")


def rank_sum_z_of_counts(counted: DataFrame, keys: list[str], group: str, first, value: str, count: str) -> DataFrame:
    """The same over (keys, group, value, count) rows: how often each group has each value."""
    by = Window.partitionBy(*keys).orderBy(value)
    values = counted.groupBy(*keys, value).agg(F.sum(count).alias("n"), F.sum(F.when(F.col(group) == F.lit(first), F.col(count)).otherwise(0)).alias("k"))
    upto = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("rank", upto - F.col("n") + (F.col("n") + 1) / F.lit(2.0))
    t = F.col("n").cast("double")
    summed = ranked.groupBy(*keys).agg(F.sum(F.col("k") * F.col("rank")).alias("rank_sum"), F.sum("k").cast("double").alias("n1"), F.sum(t).alias("n"), F.sum(t * t * t - t).alias("ties")).where("n1 > 0")
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    shift = u - n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(n2 > 0, F.when(spread > 0, (shift - F.signum(shift) * F.lit(0.5)) / spread).otherwise(0.0))
    return summed.select(*keys, u.alias("u"), z.alias("z"))


def holm(df: DataFrame, p: str, order: str | None = None, *, parts: int = 16, out: str = "adjusted") -> DataFrame:
    """Holm's step-down p-values over the whole frame: running maximum of p * (n - rank + 1), capped at 1.

    Equal values have equal results, those of the first of them, so ``order`` among them does not
    matter and only distinct values are ranked. A null value stays null and does not count.
    """
    first = F.col("_upto") - F.col("_k") + 1
    return _adjusted(df, p, parts, out, lambda n: F.col(p) * (F.lit(n) - first + 1), F.max, up=True)


def benjamini_hochberg(df: DataFrame, p: str, order: str | None = None, *, parts: int = 16, out: str = "adjusted") -> DataFrame:
    """Benjamini-Hochberg p-values over the whole frame: running minimum from the largest of p * n / rank, capped at 1.

    Equal values have the result of the last of them; nulls as in ``holm``.
    """
    return _adjusted(df, p, parts, out, lambda n: F.col(p) * F.lit(n) / F.col("_upto"), F.min, up=False)


def _adjusted(df: DataFrame, p: str, parts: int, out: str, scaled, extreme, *, up: bool) -> DataFrame:
    """Running extreme of the scaled distinct values along their order (or against it), joined back to the rows."""
    counted = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_k"))
    n = counted.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    ranked = running_total(counted, p, "_k", parts=parts, out="_upto").withColumn("_scaled", F.least(F.lit(1.0), scaled(n)))
    dealt = quantile_range(ranked, p, parts)
    whole = dealt.groupBy("_range").agg(extreme("_scaled").alias("_e"))
    order_of_ranges = Window.orderBy("_range" if up else F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_range", extreme("_e").over(order_of_ranges).alias("_b"))
    local = Window.partitionBy("_range").orderBy(p if up else F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    merge = F.greatest if up else F.least
    joined = dealt.withColumn("_l", extreme("_scaled").over(local)).join(F.broadcast(before), "_range")
    values = joined.select(F.col(p).alias("_value"), F.when(F.col("_b").isNull(), F.col("_l")).otherwise(merge("_l", "_b")).alias(out))
    return df.join(values, df[p] == values["_value"], "left").drop("_value")
