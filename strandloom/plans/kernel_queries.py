"""Kernels over the test tables. Order-dependent or numerical steps that SQL does not express."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import changepoints, exon_calls, peaks
from ..kernels.dirichlet import UsageSettings
from ..operators import paths, usage
from ..operators.streams import key_groups
from .tables import events, read, shipments

_PEAKS = pa.schema([("l_suppkey", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("support", pa.float64())])


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of each user's values in order of time."""
    rows = events(spark, sf_dir).select("user_id", "s", "event_id", "value")

    def run(user: pd.DataFrame) -> pd.DataFrame:
        values = user.sort_values(["s", "event_id"]).value.to_numpy(dtype=np.float32)
        found = changepoints.change_points(values, p=0.2, fold=0.95, window=21)
        return pd.DataFrame([(int(user.user_id.iloc[0]), c.pos, c.start, c.end, c.sign) for c in found], columns=["user_id", "pos", "start", "end", "sign"])

    return rows.groupBy("user_id").applyInPandas(run, "user_id long, pos long, start long, end long, sign long")


def end_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end peaks of each supplier's shipment intervals; the kernel sees counted ends only, one supplier at a time."""
    counted = shipments(spark, sf_dir).groupBy("l_suppkey", "d", "f").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "d", "f")

    def run(batches):
        for (supplier,), group in key_groups(batches, ["l_suppkey"]):
            d, f, n = (group.column(c).to_pylist() for c in ("d", "f", "n"))
            ends = Counter(dict(zip(zip(d, f, strict=True), n, strict=True)))
            found = peaks.chain_ends(ends, peaks.PeakSettings(support=0.1), junctions=(float("inf"), float("-inf")))
            yield pa.RecordBatch.from_pylist([{"l_suppkey": supplier, "start": a, "end": b, "support": float(k)} for a, b, k in found], _PEAKS)

    return dealt.mapInArrow(run, "l_suppkey long, start long, end long, support double")


def coverage_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep stretches of each supplier's daily shipments."""
    rows = shipments(spark, sf_dir).select("l_suppkey", "d", "f")

    def run(supplier: pd.DataFrame) -> pd.DataFrame:
        low, high = int(supplier.d.min()), int(supplier.f.max())
        depth = exon_calls.depth_of(low, high, supplier[["d", "f"]].to_numpy())
        found = exon_calls.called_exons(low, depth, [], exon_calls.RefineSettings(exon_share=0.5, least_depth=2.0))
        return pd.DataFrame([(int(supplier.l_suppkey.iloc[0]), a, b) for a, b in found], columns=["l_suppkey", "start", "end"])

    return rows.groupBy("l_suppkey").applyInPandas(run, "l_suppkey long, start long, end long")


def differential_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types' use of hours, even users against odd ones."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cell"), (F.col("user_id") % 2).alias("side"), F.col("event_type").alias("gene"), (F.col("event_id") % 3).alias("k"))
    sides = [rows.where(F.col("side") == s) for s in (0, 1)]
    genes = [x.groupBy("cell", F.col("gene").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("n")) for x in sides]
    forms = [x.groupBy("cell", F.concat_ws("-", "gene", "k").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("n")) for x in sides]
    mapping = rows.select("gene", F.concat_ws("-", "gene", "k").alias("feature"), "k").distinct().withColumnRenamed("k", "ord")
    found = usage.differential_usage(genes[0], forms[0], mapping, genes[1], forms[1], mapping, UsageSettings())
    return found.select("gene", "isoform", *(F.round(c, 6).alias(c) for c in ("pct1", "pct2", "logFC", "p_gene", "p_gene_adj", "TU1", "TU2", "p_DTU_gene", "p_transcript", "p_transcript_adj", "p_DTU_gene_adj")), "isoform_switch")


def widest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that users' hours of the day take through the day, by event type."""
    rows = events(spark, sf_dir).select("event_type", "user_id", (F.floor(F.col("s") / 3600) % 24).cast("long").alias("hour"))
    own = rows.groupBy("event_type", "user_id").agg(F.sort_array(F.collect_set("hour")).alias("nodes"), F.count(F.lit(1)).cast("double").alias("expr"))
    flagged = own.select("event_type", "nodes", "expr", (F.col("user_id") % 5 > 0).alias("has_source"), (F.col("user_id") % 7 > 0).alias("has_sink"), F.col("user_id").alias("ord"))
    return paths.widest_paths(flagged, "event_type", fraction=0.01)


QUERIES = {f.__name__: f for f in (change_points, end_peaks, coverage_exons, differential_usage, widest_paths)}
ORACLE_SQL: dict[str, str] = {}
