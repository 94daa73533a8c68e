"""Connected components of an edge table, as tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Each round points every node at its smallest neighbour below it, follows the pointers to their
    ends by doubling, and contracts the edges to those ends; the edges that remain join different
    ends. Rounds and doublings grow with the logarithm of the longest path. Every round is a
    staged table, so no lineage grows and a lost executor costs one round; hubs only meet joins
    whose large partitions Spark can split, and minima that combine before the shuffle.
    """
    live = staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        up = _ends(staged(live.groupBy("b").agg(F.min("a").alias("p")).select(F.col("b").alias("node"), F.col("p").alias("top")), "cc-up"))
        if labels is None:
            roots = live.select(F.col("a").alias("node")).join(up, "node", "left_anti").distinct().withColumn("top", F.col("node"))
            labels = staged(up.unionByName(roots), "cc-labels")
        else:
            moved = up.select(F.col("node").alias("top"), F.col("top").alias("new"))
            labels = staged(labels.join(moved, "top", "left").select("node", F.coalesce("new", "top").alias("top")), "cc-labels")
        at_a, at_b = (up.select(F.col("node").alias(x), F.col("top").alias(f"{x}_top")) for x in "ab")
        # b always has a pointer; a has one unless it is an end.
        contracted = live.join(at_b, "b").select("a", "b_top").join(at_a, "a", "left").select(F.coalesce("a_top", "a").alias("x"), F.col("b_top").alias("y")).where("x <> y")
        live = staged(contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("top").alias("component"))


def _ends(up: DataFrame) -> DataFrame:
    """Pointers followed to their ends: each round replaces a pointer by its target's pointer."""
    while True:
        next_up = up.select(F.col("node").alias("top"), F.col("top").alias("further"))
        jumped = staged(up.join(next_up, "top", "left").select("node", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")), "cc-jump")
        up = jumped.select("node", "top")
        if jumped.where("moved").isEmpty():
            return up
