"""Result files of merging, combining and single-cell quantification, as lines for ``write_files``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.combine import Combined, member_lists
from ..operators.merge import coding_spans, with_sources
from .files import write_files
from .text import SOURCE_COLOURS, bed12_line

#: Header lines of the merge reports, and the score of every merged row.
TRANSCRIPTS = "transcript_id\tnum_clusters\tsources\tstart_wobble_list\tend_wobble_list\texon_start_support\texon_end_support\tall_source_trans"
GENES = "gene_id\tnum_clusters\tnum_final_trans\tsources\tchrom\tstart\tend\tsource_genes\tsource_summary"
SCORE = "40"


def _line(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cells))


def _numbers(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")


def _pairs(starts: str, ends: str) -> Column:
    return F.transform(F.arrays_zip(starts, ends), lambda e: F.struct(e[starts].alias("start"), e[ends].alias("end")))


def merge_lines(merged: DataFrame, models: DataFrame, prefix: str, *, coding: Sequence[str] = (), naming: Sequence[str] = ()) -> DataFrame:
    """(file, gene, model, sub, line): models, their members, and reports by model and by gene; a member without a source is an error."""
    number = F.substring("gene_id", 2, 20).cast("long")
    numbered = merged.withColumn("_gene", number).withColumn("_exons", _pairs("starts", "ends"))
    told = numbered.join(coding_spans(merged, models, coding=coding, naming=naming), "model_id")
    row = bed12_line(F.col("_exons"), chrom=F.col("scaffold"), name=F.col("label"), score=F.lit(SCORE), strand=F.col("strand"), rgb=F.col("colour"), thick=(F.col("thick_start"), F.col("thick_end")))

    def of(suffix: str, df: DataFrame, sub: Column | int, line: Column) -> DataFrame:
        return df.select(F.lit(f"{prefix}{suffix}").alias("file"), F.col("_gene").alias("gene"), F.col("_model").alias("model"), (F.lit(sub) if isinstance(sub, int) else sub).cast("string").alias("sub"), line.alias("line"))

    beds = of(".bed", told.withColumn("_model", F.col("model")), 0, row)

    flat = with_sources(numbered, models, "source", "start", "end", "strand", "exons").join(numbered.select("model_id", "_gene", F.col("model").alias("_model")), "model_id")
    start = F.col("start")
    sizes = F.array_join(F.transform("exons", lambda e: (e["end"] - e["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda e: (e["start"] - start).cast("string")), ",")
    member = _line("scaffold", "start", "end", F.concat_ws(";", "model_id", "member"), F.lit(SCORE), "strand", "start", "end", F.lit(SOURCE_COLOURS[0]), F.size("exons"), sizes, starts)
    members = of("_merge.txt", flat, F.col("member"), member)

    sources = flat.groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    support = lambda c: F.array_join(c, ";")
    transcripts = of("_trans_report.txt", numbered.withColumn("_model", F.col("model")).join(sources, "model_id"), 0, _line("model_id", F.size("members"), "sources", _numbers("start_wobble"), _numbers("end_wobble"), support("start_support"), support("end_support"), F.array_join("members", ",")))

    track = F.regexp_replace("member", r"\.[^.]*$", "")
    tracks = flat.select("gene_id", track.alias("track")).distinct()
    counted = tracks.groupBy("gene_id", F.substring_index("track", "_", 1).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    summary = counted.groupBy("gene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("of", "n"))), lambda x: F.concat_ws(":", x["of"], x["n"].cast("string"))), ",").alias("summary"))
    genes = flat.groupBy("gene_id", "_gene", "scaffold", "gene_start", "gene_end").agg(F.countDistinct("member").alias("members"), F.countDistinct("model_id").alias("models"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set(track)), ",").alias("tracks"))
    by_gene = of("_gene_report.txt", genes.join(summary, "gene_id").withColumn("_model", F.lit(0).cast("long")), 0, _line("gene_id", "members", "models", "sources", "scaffold", "gene_start", "gene_end", "tracks", "summary"))
    return beds.unionByName(members).unionByName(transcripts).unionByName(by_gene)


def write_merge(merged: DataFrame, models: DataFrame, path: str, prefix: str = "merged", **options) -> None:
    """``<prefix>.bed``, ``_trans_report.txt``, ``_gene_report.txt`` and ``_merge.txt`` below ``path``, which must not exist."""
    files = [f"{prefix}{x}" for x in (".bed", "_trans_report.txt", "_gene_report.txt", "_merge.txt")]
    write_files(merge_lines(merged, models, prefix, **options), path, files, "gene", "model", "sub", headers={files[1]: TRANSCRIPTS, files[2]: GENES})


def combine_lines(combined: Combined, samples: Sequence[str], prefix: str, sequences: DataFrame | None = None) -> DataFrame:
    """(file, chain, end_number, at, line): isoforms, their sources, counts by sample, and sequences of (rep_sample, rep_name, seq) where given."""
    place = lambda p: (F.col(f"{p}.chain").alias("chain"), F.col(f"{p}.end_number").cast("long").alias("end_number"), F.col(f"{p}.at").cast("long").alias("at"))
    bed_line = bed12_line(F.col("exons"), chrom=F.col("chrom"), name=F.col("name"), score=F.lit("1000"), strand=F.col("strand"), rgb=F.lit("0"), trailing=True)
    own = (F.col("chain"), F.col("end_number").cast("long").alias("end_number"), F.col("pos").cast("long").alias("at"))
    beds = combined.bed.select(F.lit(f"{prefix}.bed").alias("file"), *own, bed_line.alias("line"))
    lists = member_lists(combined).select(F.lit(f"{prefix}.isoform.map.txt").alias("file"), *place("place"), F.concat_ws("\t", "name", F.array_join("members", "\t")).alias("line"))
    held = F.map_from_entries(F.collect_list(F.struct("sample", "n")))
    summed = combined.support.groupBy("name", "sample").agg(F.sum("counts").alias("n"), F.min("place").alias("place"))
    wide = summed.groupBy("name").agg(held.alias("held"), F.min("place").alias("place"))
    cells = F.array_join(F.transform(F.array(*map(F.lit, samples)), lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0)).cast("string")), "\t")
    counts = wide.select(F.lit(f"{prefix}.counts.tsv").alias("file"), *place("place"), F.concat_ws("\t", "name", cells).alias("line"))
    out = beds.unionByName(lists).unionByName(counts)
    if sequences is None:
        return out
    known = combined.bed.where("pos = 0").join(sequences, ["rep_sample", "rep_name"], "left")
    missing = F.raise_error(F.concat(F.lit("no sequence for "), F.col("rep_name")))
    records = known.select(F.lit(f"{prefix}.fa").alias("file"), *own, F.concat(F.lit(">"), "name", F.lit("\n"), F.coalesce("seq", missing)).alias("line"))
    return out.unionByName(records)


def write_combine(combined: Combined, samples: Sequence[str], path: str, prefix: str = "combined", sequences: DataFrame | None = None) -> None:
    """``<prefix>.bed``, ``.counts.tsv``, ``.isoform.map.txt`` and, with ``sequences``, ``.fa`` below ``path``."""
    files = [f"{prefix}{x}" for x in (".bed", ".counts.tsv", ".isoform.map.txt", *([".fa"] if sequences is not None else []))]
    write_files(combine_lines(combined, samples, prefix, sequences), path, files, "chain", "end_number", "at", headers={files[1]: "\t".join(["ids", *samples])})


def _csv(text: Column) -> Column:
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def matrix_file(counts: DataFrame, file: str) -> DataFrame:
    """(file, cell, line): a zero-filled CSV matrix of (cell, feature, n), features in order of name; the header has a null cell.

    Features are numbered by a table, and a cell's line is filled from its own counts: no pivot, and
    no list of features on the driver. A line is as long as there are features; nothing else is.
    """
    features = counts.select("feature").distinct()
    names = features.agg(F.sort_array(F.collect_list("feature")).alias("names"))  # the header is one line of the file
    header = names.select(F.lit(file).alias("file"), F.lit(None).cast("string").alias("cell"), F.concat_ws(",", F.lit("cell"), F.array_join(F.transform("names", _csv), ",")).alias("line"))
    numbered = names.select(F.posexplode("names").alias("at", "feature"), F.size("names").alias("width"))
    summed = counts.groupBy("cell", "feature").agg(F.sum("n").cast("long").alias("n"))
    gathered = summed.join(numbered, "feature").groupBy("cell", "width").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = []
            for width, at, n in zip(frame.width, frame["at"], frame.n, strict=True):
                row = np.zeros(width, dtype=np.int64)
                row[np.asarray(at, dtype=np.int64)] = np.asarray(n)
                lines.append(",".join(map(str, row.tolist())))
            yield pd.DataFrame({"cell": frame.cell, "text": lines})

    filled = gathered.mapInPandas(run, "cell string, text string")
    return header.unionByName(filled.select(F.lit(file).alias("file"), "cell", F.concat_ws(",", _csv(F.col("cell")), "text").alias("line")))


def sample_lines(counts: DataFrame, number: int) -> DataFrame:
    """(file, cell, line) of one sample's counts (cell, label, isoform, n): matrices of genes and transcripts, and which transcript is whose."""
    named = counts.withColumn("cell", F.concat(F.col("cell"), F.lit(f":sample{number}")))
    genes = matrix_file(named.select("cell", F.col("label").alias("feature"), "n"), "gene_counts.csv")
    transcript = F.concat_ws("_", "label", "isoform")
    isoforms = matrix_file(named.select("cell", transcript.alias("feature"), "n"), "transcript_counts.csv")
    pairs = counts.select("label", transcript.alias("transcript")).distinct()
    listed = pairs.select(F.lit("gene_transcript.tsv").alias("file"), F.concat_ws("\t", "label", "transcript").alias("cell"), F.concat_ws("\t", "label", "transcript").alias("line"))
    return genes.unionByName(isoforms).unionByName(listed)


def write_sample(counts: DataFrame, number: int, path: str) -> None:
    """``gene_counts.csv``, ``transcript_counts.csv`` and ``gene_transcript.tsv`` of a sample below ``path``."""
    write_files(sample_lines(counts, number), path, ["gene_counts.csv", "transcript_counts.csv", "gene_transcript.tsv"], "cell", headers={"gene_transcript.tsv": "genes\ttranscripts"})
