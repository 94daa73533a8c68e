"""Ordered scans along keys of any size: clusters, coverage and pieces, bin by bin, with a carried state.

A scan along a chromosome needs what lies before each row. Here rows are dealt to bins of their
position; what a bin hands on (its furthest end, its last row, its sum) is one row a bin, folded
over the bins of a key; and each bin is then scanned by itself from the state it is handed. No
task holds a key, only a bin, and the fold holds one row a bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .intervals import _boundary_changes


def _dealt(df: DataFrame, keys: list[str], position: str, width: int) -> tuple[DataFrame, WindowSpec]:
    return df.withColumn("_bin", F.floor(F.col(position) / width)), Window.partitionBy(*keys, "_bin")


def _handed(rows: DataFrame, keys: list[str], gathered: list[Column], handed: list[Column]) -> DataFrame:
    """Rows with what the other bins of their key hand on; null keys are a key."""
    bins = rows.groupBy(*keys, "_bin").agg(*gathered).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_bin"))), *handed)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "_bin"))))
    return rows.join(bins, same).drop(*(f"_k{i}" for i in range(len(keys) + 1)))


def _numbered(flagged: DataFrame, keys: list[str], order: WindowSpec, out: str) -> DataFrame:
    """The running count of ``_new``, from the count of the bins before."""
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = _handed(flagged, keys, [F.sum("_new").alias("_n")], [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_upto")])
    local = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn(out, (local + F.col("_upto")).cast("long")).drop("_new", "_upto", "_bin")


def cluster_by_bins(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], *, width: int, gap: int = 0, out: str = "cluster_id") -> DataFrame:
    """Numbers of clusters from 1 along each key: one begins where a start lies more than ``gap`` beyond all ends before.

    Whole positions. ``gap`` 0: touching intervals are one cluster; -1: only overlapping ones; above
    0: holes up to it are bridged. ``order`` breaks ties of starts.
    """
    rows, bins = _dealt(df, keys, start, width)
    along = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = _handed(rows, keys, [F.max(end).alias("_far")], [F.max("_far").over(along).alias("_before")])
    local = bins.orderBy(start, *order)
    reach = F.greatest(F.max(end).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    flagged = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).drop("_before")
    return _numbered(flagged, keys, local, out)


def chain_by_bins(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], *, width: int, window: int, out: str = "cluster_id") -> DataFrame:
    """Numbers of chains from 1 along each key: a row whose start or end lies more than ``window`` beyond its predecessor's begins one."""
    rows, bins = _dealt(df, keys, start, width)
    pair = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    along = Window.partitionBy(*keys).orderBy("_bin")
    rows = _handed(rows, keys, [F.max_by(pair, F.struct(start, *order)).alias("_last")], [F.lag("_last").over(along).alias("_before")])
    local = bins.orderBy(start, *order)
    previous = F.coalesce(F.lag(pair).over(local), F.col("_before"))
    far = (F.col(start) - previous["s"] > window) | (F.col(end) - previous["e"] > window)
    flagged = rows.withColumn("_new", F.when(previous.isNull() | far, 1).otherwise(0)).drop("_before")
    return _numbered(flagged, keys, local, out)


def _depths(df: DataFrame, keys: list[str], start: str, end: str, weight: Column, width: int, changed_only: bool) -> tuple[DataFrame, WindowSpec]:
    """Boundaries (keys, start, end, depth) up to the next boundary of the key."""
    changes = _boundary_changes(df, keys, start, end, weight)
    rows, bins = _dealt(changes.where("d <> 0") if changed_only else changes, keys, "pos", width)
    along = Window.partitionBy(*keys).orderBy("_bin")
    handed = [F.coalesce(F.sum("_d").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(along).alias("_after")]
    rows = _handed(rows, keys, [F.sum("d").alias("_d"), F.min("pos").alias("_first")], handed)
    local = bins.orderBy("pos")
    depth = F.sum("d").over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ends = F.coalesce(F.lead("pos").over(local), F.col("_after"))
    return rows.select(*keys, "_bin", F.col("pos").alias("start"), ends.alias("end"), depth.alias("depth")), bins


def coverage_by_bins(df: DataFrame, keys: list[str], start: str, end: str, *, width: int, weight: Column | None = None) -> DataFrame:
    """Run-length encoded coverage (keys, start, end, depth) without runs of zero, as ``coverage_segments``."""
    found, _ = _depths(df, keys, start, end, F.lit(1) if weight is None else weight, width, True)
    return found.where("depth <> 0 AND end IS NOT NULL").drop("_bin")


def pieces_by_bins(df: DataFrame, keys: list[str], start: str, end: str, *, width: int) -> DataFrame:
    """The covered pieces between all boundaries, numbered along each key, as ``disjoint_pieces``."""
    found, bins = _depths(df, keys, start, end, F.lit(1), width, False)
    covered = found.where("depth > 0 AND end IS NOT NULL").withColumn("_new", F.lit(1))
    return _numbered(covered, keys, bins.orderBy("start"), "piece").select(*keys, "start", "end", "piece")
