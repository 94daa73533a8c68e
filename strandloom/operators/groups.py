"""Grouping, voting and selection operators on built-in aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (made total by its last column)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def keep_best_passing(df: DataFrame, keys: list[str], passing: Column, value: str, order: str) -> DataFrame:
    """The first row with the highest passing value; the first row where none passes."""
    rank = Window.partitionBy(*keys).orderBy(passing.desc(), F.when(passing, F.col(value)).desc(), F.col(order))
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def vote(df: DataFrame, keys: list[str], coordinate: str, *, priority: str | None = None, largest: bool = False) -> DataFrame:
    """The winning coordinate of each key: lowest priority first, then most votes, then the smallest (or largest)."""
    by = [*keys, *([priority] if priority else []), coordinate]
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("votes"))
    tie = -F.col(coordinate) if largest else F.col(coordinate)
    order = F.struct(*([F.col(priority)] if priority else []), (-F.col("votes")).alias("v"), tie.alias("t"))
    return counted.groupBy(*keys).agg(F.min_by(F.struct(coordinate, "votes"), order).alias("w")).select(*keys, F.col(f"w.{coordinate}").alias(coordinate), F.col("w.votes").alias("votes"))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most common value of each key; of equally common ones the first seen."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "seen")).alias(value))


def gap_groups(df: DataFrame, keys: list[str], order: list[str], advances: list[tuple[str, int]], out: str = "group_id") -> DataFrame:
    """Number groups of rows in order; a new one starts where a column advances by more than its window from the row before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    far = F.lit(False)
    for column, window in advances:
        far = far | (F.col(column) - F.coalesce(F.lag(column).over(by), F.col(column)) > window)
    return df.withColumn("_far", far.cast("int")).withColumn(out, F.sum("_far").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_far")


def keep_chains(groups: DataFrame, keys: list[str], *, usage: str, count: str, order: str, length: str, least_usage: float, least_count: float, rule: str) -> DataFrame:
    """Which end groups of a chain stay: ``none`` all; ``usage`` chains whose largest usage exceeds the threshold;
    ``count`` chains whose counts sum to more than the threshold; ``longest`` also needs the last group with a length."""
    totals = groups.groupBy(*keys).agg(F.max(usage).alias("max_usage"), F.sum(count).alias("sum_count"), F.max(F.when(F.col(length) > 0, F.col(order))).alias("last_group"))
    joined = groups.join(totals, keys)
    keep = {"none": F.lit(True), "usage": F.col("max_usage") > least_usage, "count": F.col("sum_count") > least_count, "longest": (F.col("max_usage") > least_usage) & (F.col(order) == F.col("last_group"))}[rule]
    return joined.withColumn("keep", keep)


def usage_with_other(df: DataFrame, gene: str, feature: str, count: str, rare: float) -> DataFrame:
    """Counts by gene and feature, features below a share of ``rare`` gathered as ``other``."""
    by = df.groupBy(gene, feature).agg(F.sum(count).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(gene))
    named = by.withColumn("feature", F.when(share >= rare, F.col(feature).cast("string")).otherwise(F.lit("other")))
    return named.groupBy(gene, "feature").agg(F.sum("n").alias("n"))


def support_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Row x column counts, zero-filled; the columns are given, so no pass is spent on finding them."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def ordered_ids(df: DataFrame, keys: list[str], value: str, order: str, out: str, separator: str = ",") -> DataFrame:
    """Each key's values joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["_v"]), separator).alias(out))


def shared_member_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with the same set of members: (members, keys), both sorted and joined by commas."""
    sets = df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(member)), lambda x: x.cast("string")), ",").alias("members"))
    return sets.groupBy("members").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("keys"), F.count(F.lit(1)).alias("n_keys"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
