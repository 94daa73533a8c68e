"""Interval operators: clusters, joins, partitions and coverage, all on built-in expressions.

Coordinates are half-open unless an operator says otherwise. Overlap rules differ from caller to
caller, so each operator names its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_intervals(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], *, touching: bool, out: str = "cluster_id") -> DataFrame:
    """Number the clusters of overlapping intervals within ``keys``, in order of start.

    ``touching``: an interval that begins where the cluster so far ends still belongs to it.
    One shuffle on ``keys``; order the ties by ``order`` for a total order.
    """
    by = Window.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col(start) > reach if touching else F.col(start) >= reach
    flagged = df.withColumn("_new", F.when(reach.isNull() | new, 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def cluster_spans(clustered: DataFrame, keys: list[str], start: str, end: str, *more: Column, cluster: str = "cluster_id") -> DataFrame:
    """One row a cluster: its span, its size and further aggregates."""
    return clustered.groupBy(*keys, cluster).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"), *more)


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], *, width: int, left_span: tuple[str, str], right_span: tuple[str, str], containment: bool = False) -> DataFrame:
    """Pairs whose intervals overlap (or, for ``containment``, whose right one holds the left one).

    An equi-join on (keys, bucket): both sides are dealt to the fixed-width buckets they cross, and
    a pair counts only in the first bucket the two share, so no distinct is needed. A plain range
    condition would plan as a nested loop.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = left.withColumn("_bucket", F.explode(_buckets(F.col(ls), F.greatest(F.col(le), F.col(ls) + 1), width)))
    b = right.withColumn("_bucket", F.explode(_buckets(F.col(rs), F.greatest(F.col(re), F.col(rs) + 1), width)))
    joined = a.join(b, [*on, "_bucket"])
    overlap = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    if containment:
        overlap = (F.col(rs) <= F.col(ls)) & (F.col(le) <= F.col(re))
    first = F.col("_bucket") == F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    return joined.where(overlap & first).drop("_bucket")


def nearest_site(points: DataFrame, sites: DataFrame, keys: list[str], position: str, *, point_order: str, window: int) -> DataFrame:
    """Each point with the nearest site of its keys at most ``window`` away; the lower site on ties, else null.

    An as-of search in both directions over the union, one shuffle; no range join.
    """
    both = points.withColumn("_site", F.lit(None).cast("long")).unionByName(sites.select(*keys, position, F.col(position).alias("_site")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(position)
    before = F.last("_site", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_site", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", before).withColumn("_a", after).where(F.col("_site").isNull() & F.col(point_order).isNotNull())
    left, right = F.col(position) - F.col("_b"), F.col("_a") - F.col(position)
    pick = F.when((left <= window) & (F.col("_a").isNull() | (right > window) | (left <= right)), F.col("_b")).when(right <= window, F.col("_a"))
    return near.withColumn("site", pick).drop("_site", "_a", "_b")


def _boundary_changes(df: DataFrame, keys: list[str], start: str, end: str, weight: Column) -> DataFrame:
    changes = F.explode(F.array(F.struct(F.col(start).alias("pos"), weight.alias("d")), F.struct(F.col(end).alias("pos"), (-weight).alias("d"))))
    return df.where(F.col(start) < F.col(end)).select(*keys, changes.alias("c")).select(*keys, "c.pos", "c.d").groupBy(*keys, "pos").agg(F.sum("d").alias("d"))


def coverage_segments(df: DataFrame, keys: list[str], start: str, end: str, weight: Column | None = None) -> DataFrame:
    """Run-length encoded coverage: (keys, start, end, depth), zero runs left out.

    Boundaries instead of bases: +w and -w at the ends, combined before the shuffle; a running sum;
    boundaries at which the depth stays the same are dropped.
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    depth = _boundary_changes(df, keys, start, end, F.lit(1) if weight is None else weight).where("d <> 0").withColumn("depth", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return depth.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(by).alias("end"), "depth").where("depth <> 0 AND end IS NOT NULL")


def disjoint_pieces(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The covered pieces between all boundaries of overlapping intervals, numbered in order."""
    by = Window.partitionBy(*keys).orderBy("pos")
    depth = _boundary_changes(df, keys, start, end, F.lit(1)).withColumn("depth", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = depth.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(by).alias("end"), "depth").where("depth > 0 AND end IS NOT NULL")
    return pieces.withColumn("piece", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("depth")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal ``value`` in order within ``keys``: (keys, run, value, n)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    runs = df.select(*keys, *[c for c in order if c not in keys], value).withColumn("_new", new).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))
