"""One annotation from several sources' BED12 models."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.collapse import genes_of
from ..kernels.merge import SourceModel, merge_gene
from ..kernels.models import Model, Tolerance
from ..sinks.text import source_colour
from .collapse import numbered_models
from .intervals import cluster_intervals

_OUT = "scaffold string, locus long, strand string, gene long, model long, gene_start long, gene_end long, starts array<long>, ends array<long>, members array<string>, start_wobble array<long>, end_wobble array<long>, start_support array<string>, end_support array<string>"


def source_models(bed: DataFrame, source: str, *, capped: bool, priority: tuple[int, int, int]) -> DataFrame:
    """A source's rows (chrom, start, end, name ``gene;transcript``, strand, exons) with its manifest entries."""
    return bed.select("chrom", "start", "end", F.concat_ws("_", F.lit(source), F.element_at(F.split("name", ";"), 2)).alias("member"), F.element_at(F.split("name", ";"), 1).alias("source_gene"), F.lit(source).alias("source"), "strand", "exons", "thick_start", "thick_end", F.lit(capped).alias("capped"), F.array(*map(F.lit, priority)).alias("priority"))


def merge(models: DataFrame, tolerance: Tolerance = Tolerance(20, 10, 10), *, longest: bool = False) -> DataFrame:
    """Numbered merged models. Loci are rows whose spans overlap (touching splits); a locus and strand is one kernel call."""
    loci = cluster_intervals(models, ["chrom"], "start", "end", ["end", "member"], touching=False, out="locus")
    columns = [c.split()[0] for c in _OUT.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("member")
        own = [SourceModel(r.member, Model(r.strand, tuple((e["start"], e["end"]) for e in r.exons)), bool(r.capped), tuple(int(p) for p in r.priority)) for r in frame.itertuples(index=False)]
        spans = dict(zip(frame.member, zip(frame.start, frame.end, strict=True), strict=True))
        out = []
        for g, members in enumerate(genes_of([m.model for m in own]), 1):
            gene = [own[k] for k in members]
            low, high = min(spans[m.name][0] for m in gene), max(spans[m.name][1] for m in gene)
            for k, x in enumerate(merge_gene(gene, tolerance, longest=longest), 1):
                out.append((frame.chrom.iloc[0], frame.locus.iloc[0], frame.strand.iloc[0], g, k, low, high, [s for s, _ in x.exons], [e for _, e in x.exons], x.members, x.start_wobble, x.end_wobble, [",".join(s) for s in x.start_support], [",".join(s) for s in x.end_support]))
        return pd.DataFrame(out, columns=columns)

    merged = loci.select("chrom", "locus", "strand", "member", "start", "end", "exons", "capped", "priority").groupBy("chrom", "locus", "strand").applyInPandas(run, _OUT)
    return numbered_models(merged)


def with_sources(merged: DataFrame, models: DataFrame, *columns: str) -> DataFrame:
    """(gene_id, model_id, member, columns): every member with what its source says of it; a member without a source is an error."""
    flat = merged.select("gene_id", "model_id", "scaffold", "gene_start", "gene_end", F.explode("members").alias("member"))
    joined = flat.join(models.select("member", *columns, F.lit(True).alias("_known")), "member", "left")
    missing = F.raise_error(F.concat(F.lit("no source model for member "), F.coalesce("member", F.lit("null"))))
    return joined.withColumn("member", F.when(F.col("_known"), F.col("member")).otherwise(missing)).drop("_known")


def gene_report(merged: DataFrame, models: DataFrame) -> DataFrame:
    """Each gene's models, members, sources, span and source genes."""
    flat = with_sources(merged, models, "source", "source_gene")
    return flat.groupBy("gene_id", "scaffold", "gene_start", "gene_end").agg(F.countDistinct("member").alias("members"), F.countDistinct("model_id").alias("models"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("_", "source", "source_gene"))), ",").alias("source_genes"))


def coding_spans(merged: DataFrame, models: DataFrame, *, coding: Sequence[str] = (), naming: Sequence[str] = ()) -> DataFrame:
    """(model_id, thick_start, thick_end, colour, label) of merged models, from what their members' sources say.

    The coding span is that of the last member, by name, of the ``coding`` sources; without one, or
    where it starts at 0, the model's own span. ``label`` is gene and model, then source gene and
    transcript of every member of the ``naming`` sources. The colour is the source's by its place
    among all names, or the last for several. A member without a source is an error.
    """
    names = [r.source for r in models.select("source").distinct().orderBy("source").collect()]  # a row a source
    listed = lambda sources: F.col("source").isin(*sources) if sources else F.lit(False)
    flat = with_sources(merged, models, "source", "source_gene", "thick_start", "thick_end")
    own = F.when(listed(coding), F.col("member"))
    transcript = F.expr("substring(member, length(source) + 2)")
    told = F.sort_array(F.collect_list(F.when(listed(naming), F.struct("member", F.concat_ws(";", "source_gene", transcript).alias("text")))))
    spans = flat.groupBy("model_id").agg(F.max_by("thick_start", own).alias("_s"), F.max_by("thick_end", own).alias("_e"), F.min("source").alias("_source"), F.countDistinct("source").alias("_n"), told.alias("_told"))
    rows = merged.select("gene_id", "model_id", F.element_at("starts", 1).alias("_first"), F.element_at("ends", -1).alias("_last")).join(spans, "model_id")
    ours = F.coalesce(F.col("_s"), F.lit(0)) == 0
    label = F.array_join(F.concat(F.array("gene_id", "model_id"), F.transform("_told", lambda t: t["text"])), ";")
    return rows.select("model_id", F.when(ours, F.col("_first")).otherwise(F.col("_s")).alias("thick_start"), F.when(ours, F.col("_last")).otherwise(F.col("_e")).alias("thick_end"), source_colour(F.col("_source"), names, F.col("_n") > 1).alias("colour"), label.alias("label"))
