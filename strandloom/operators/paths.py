"""Widest paths through the path graph of each locus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.path_graph import PathGraph


def widest_paths(paths: DataFrame, locus: str, *, k: int = 1, fraction: float = 0.0, most: int = 0) -> DataFrame:
    """(locus, rank, nodes, expr): paths by falling flow through the k-mers of each locus's paths.

    ``paths``: nodes (array of long), expr, has_source, has_sink, ord (gives the order in which nodes
    are first seen, which decides ties). Equal paths are summed before they are gathered, so a task
    holds a locus's distinct paths, not its reads. Paths shorter than ``k`` count only where they
    run from source to sink. Null and empty paths are left out; so is a locus that no path crosses. Loose ends are carried on before paths are taken.
    """
    by = [locus, "nodes", "has_source", "has_sink"]
    counted = paths.where(F.size("nodes") > 0).groupBy(*by).agg(F.sum("expr").alias("expr"), F.min("ord").alias("ord"))
    row = F.struct("ord", "nodes", "has_source", "has_sink", "expr")
    gathered = counted.groupBy(locus).agg(F.sort_array(F.collect_list(row)).alias("paths"))
    kind = gathered.schema[locus].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, rows in zip(frame[locus], frame["paths"], strict=True):
                graph = PathGraph()
                for r in rows:
                    nodes = tuple(int(n) for n in r["nodes"])
                    if len(nodes) >= k or (r["has_source"] and r["has_sink"]):
                        mers = [nodes[i : i + k] for i in range(max(len(nodes) - k, 0) + 1)]
                        graph.add(mers, r["expr"], from_source=bool(r["has_source"]), to_sink=bool(r["has_sink"]))
                graph.prune()
                graph.smooth()
                for rank, (mers, expr) in enumerate(graph.widest_paths(fraction, most), 1):
                    out.append((key, rank, [*mers[0], *(m[-1] for m in mers[1:])], expr))
            yield pd.DataFrame(out, columns=[locus, "rank", "nodes", "expr"])

    return gathered.mapInPandas(run, f"`{locus}` {kind}, rank long, nodes array<long>, expr double")
