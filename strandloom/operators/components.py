"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): of every node with an edge, the smallest node it is connected with.

    In a round each node takes the least of its own label and its neighbours', and then the label of
    that label, so that labels travel twice as far each time; rounds grow with the logarithm of the
    longest way for paths in order, and never beyond its length. Nulls make no edge. Every round is a staged
    table; minima combine before the shuffle, so a hub is no hot key.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = staged(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "components-edges")
    labels = staged(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")), "components-labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        further = labels.select(F.col("x").alias("label"), F.col("label").alias("further"))
        least = labels.join(near, "x").join(further, "label").select("x", "label", F.least("label", "near", "further").alias("next"))
        found = staged(least, "components-round")
        labels = found.select("x", F.col("next").alias("label"))
        if found.where("next < label").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
