"""Isoforms with precise ends from aligned reads: by junction chain, or by place for unspliced reads."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import introns
from ..kernels import peaks
from ..kernels.peaks import PeakSettings
from .intervals import cluster_intervals

_OUT = "ord long, sub long, chrom string, start long, end long, name string, strand string, exons array<struct<start:bigint,end:bigint>>, support double, strands long"
_COLUMNS = [c.split()[0] for c in _OUT.replace("array<struct<start:bigint,end:bigint>>", "x").split(", ")]


def _annotated(reads: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Adds the chromosome's annotated starts and ends near the row, as arrays."""
    empty = F.expr("CAST(array() AS array<bigint>)")
    if ends is None:
        return reads.withColumn("tss_known", empty).withColumn("tes_known", empty)
    by = ends.groupBy("chrom").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "tss", F.col("pos")))).alias("_s"), F.array_sort(F.collect_set(F.when(F.col("kind") == "tes", F.col("pos")))).alias("_e"))
    near = lambda c: F.filter(F.coalesce(c, empty), lambda p: (p >= F.col("low")) & (p <= F.col("high")))
    return reads.join(by, "chrom", "left").withColumn("tss_known", near(F.col("_s"))).withColumn("tes_known", near(F.col("_e"))).drop("_s", "_e")


def spliced_isoforms(bed: DataFrame, settings: PeakSettings = PeakSettings(), *, ends: DataFrame | None = None, no_splice: tuple[str, ...] = ("chrM",)) -> DataFrame:
    """Isoforms of spliced reads (ord, chrom, start, end, name, strand, exons).

    Reads are counted by chain and ends before the shuffle; a chain's kernel sees distinct ends
    only. The chain's first row is the template; further isoforms of a chain are numbered.
    """
    rows = bed.where((F.size("exons") > 1) & ~F.col("chrom").isin(*no_splice)).withColumn("chain", introns(F.col("exons")))
    counted = rows.groupBy("chrom", "chain", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("ord", "name", "strand", "exons"), "ord").alias("t"))
    spans = counted.groupBy("chrom", "chain").agg(F.sort_array(F.collect_list(F.struct("start", "end", "n"))).alias("ends"), F.min_by("t", "t.ord").alias("t"), (F.min("start") - settings.window).alias("low"), (F.max("end") + settings.window).alias("high"))
    known = _annotated(spans, ends).select("chrom", "ends", "t", "tss_known", "tes_known")

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                exons = [(e["start"], e["end"]) for e in r.t["exons"]]
                found = peaks.chain_ends(Counter({(e["start"], e["end"]): e["n"] for e in r.ends}), settings, starts_known=set(r.tss_known), ends_known=set(r.tes_known), junctions=(exons[0][1], exons[-1][0]))
                for k, (start, end, support) in enumerate(found):
                    name = peaks.renamed(r.t["name"], k) if k else r.t["name"]
                    blocks = [[start, exons[0][1]], *map(list, exons[1:-1]), [exons[-1][0], end]]
                    out.append((r.t["ord"], k, r.chrom, start, end, name, r.t["strand"], [{"start": a, "end": b} for a, b in blocks], float(support), 0))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return known.mapInPandas(run, _OUT)


def unspliced_isoforms(bed: DataFrame, settings: PeakSettings = PeakSettings(), *, ends: DataFrame | None = None) -> DataFrame:
    """Isoforms of unspliced reads. Reads are cut into stretches that nothing bridges, each grouped by itself; only the
    found isoforms of a chromosome meet, to even out their ends. ``strands`` is the count of the commonest strand."""
    counted = bed.where(F.size("exons") == 1).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("ord", "name", "strand"), "ord").alias("t"))
    stretched = cluster_intervals(counted, ["chrom"], "start", "end", ["end"], touching=True, out="stretch")
    spans = stretched.groupBy("chrom", "stretch").agg(F.sort_array(F.collect_list(F.struct("start", "end", "n", "t"))).alias("reads"), (F.min("start") - settings.window).alias("low"), (F.max("end") + settings.window).alias("high"))
    known = _annotated(spans, ends).select("chrom", "stretch", "reads", "tss_known", "tes_known")

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                groups = peaks.group_reads([(x["start"], x["end"], x["n"], x["t"]["name"], x["t"]["strand"]) for x in r.reads], settings.window)
                for k, g in enumerate(groups):
                    for start, end, support, *_ in peaks.end_pairs(g.ends, settings, results=1, starts_known=set(r.tss_known), ends_known=set(r.tes_known), junctions=(g.low, g.high)):
                        strand = g.strands.most_common(1)[0]
                        out.append((r.stretch, k, r.chrom, start, end, g.name, strand[0], [{"start": start, "end": end}], float(support), strand[1]))
            yield pd.DataFrame(out, columns=_COLUMNS)

    def even_out(chrom: pd.DataFrame) -> pd.DataFrame:
        merged: dict[tuple[int, int], dict] = {}
        names: Counter[str] = Counter()
        for r in chrom.sort_values(["ord", "sub"], kind="stable").to_dict("records"):
            own = merged.get((r["start"], r["end"]))
            if own:
                own["support"] += r["support"]
                continue
            seen = names[r["name"]]
            names[r["name"]] += 1
            merged[r["start"], r["end"]] = r | {"name": peaks.renamed(r["name"], seen)} if seen else r
        rows = list(merged.values())
        if not settings.per_isoform:
            rows = peaks.homogenised(rows, settings.window)
        return pd.DataFrame([x | {"exons": [{"start": x["start"], "end": x["end"]}]} for x in rows], columns=_COLUMNS)

    return known.mapInPandas(run, _OUT).groupBy("chrom").applyInPandas(even_out, _OUT)
