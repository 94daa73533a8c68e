"""Line expressions and ordered text output.

A line is an expression of a row; a file is its lines in an explicit order. ``write_lines`` writes
range-sorted part files in order; ``single_file`` joins them into one, streaming on the driver one
part at a time, for outputs that must be one file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import block_lists, split_name

#: The display colours of sources by index; the last marks several sources.
SOURCE_COLOURS = ("255,0,0", "255,100,0", "255,200,0", "200,255,0", "0,255,200", "0,200,255", "0,100,255", "0,0,255", "100,0,255", "200,0,255")


def bed12_line(exons: Column, *, chrom: Column, name: Column, score: Column, strand: Column, rgb: Column, thick: tuple[Column, Column] | None = None, trailing: bool = False) -> Column:
    """A BED12 row from half-open exons."""
    start, end = F.element_at(exons, 1)["start"], F.element_at(exons, -1)["end"]
    sizes, starts = block_lists(exons, start)
    comma = F.lit(",") if trailing else F.lit("")
    low, high = thick or (start, end)
    return F.concat_ws("\t", chrom, start.cast("string"), end.cast("string"), name, score.cast("string"), strand, low.cast("string"), high.cast("string"), rgb, F.size(exons).cast("string"), F.concat(sizes, comma), F.concat(starts, comma))


def source_colour(name: Column, sources: list[str], several: Column) -> Column:
    """The colour of a source by its place among the sorted names, or that of several sources."""
    at = F.array_position(F.array(*map(F.lit, sorted(sources))), name)
    return F.when(several, F.lit(SOURCE_COLOURS[9])).otherwise(F.element_at(F.array(*map(F.lit, SOURCE_COLOURS)), F.least(at, F.lit(10)).cast("int")))


def gtf_rows(models: DataFrame, *, source: str, coding: bool = False) -> DataFrame:
    """(ord, sub, line): transcript and exon rows of (ord, chrom, strand, name, exons[, thick_start, thick_end]).

    With ``coding``, exon numbers start at 0 and models whose thick span is narrower than their
    own get CDS, start codon and UTR rows.
    """
    transcript, gene = split_name(F.col("name"))
    start, end = F.element_at("exons", 1)["start"], F.element_at("exons", -1)["end"]
    ids = F.format_string('gene_id "%s"; transcript_id "%s";', gene, transcript)

    def row(feature: str, a: Column, b: Column, more: Column) -> Column:
        return F.concat_ws("\t", "chrom", F.lit(source), F.lit(feature), (a + 1).cast("string"), b.cast("string"), F.lit("."), "strand", F.lit("."), more)

    numbered = lambda i: F.concat(ids, F.format_string(' exon_number "%d";', i))
    exon_rows = F.transform("exons", lambda e, i: F.struct((i + 1).cast("long").alias("sub"), row("exon", e["start"], e["end"], numbered(i) if coding else ids).alias("line")))
    rows = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("sub"), row("transcript", start, end, ids).alias("line"))), exon_rows)
    if coding:
        lo, hi = F.col("thick_start"), F.col("thick_end")
        coded = (lo < hi) & ((lo > start) | (hi < end))
        cds = F.filter(F.transform("exons", lambda e, i: F.struct((10_000 + i).cast("long").alias("sub"), F.when((e["end"] > lo) & (e["start"] < hi), row("CDS", F.greatest(e["start"], lo), F.least(e["end"], hi), numbered(i))).alias("line"))), lambda r: r["line"].isNotNull())
        at = F.when(F.col("strand") == "+", lo).otherwise(hi - 3)
        codon = F.array(F.struct(F.lit(20_000).cast("long").alias("sub"), row("start_codon", at, at + 3, ids).alias("line")))
        five = F.when(F.col("strand") == "+", "5UTR").otherwise("3UTR")
        three = F.when(F.col("strand") == "+", "3UTR").otherwise("5UTR")
        utr = lambda name, a, b, base: F.filter(F.transform("exons", lambda e, i: F.struct((base + i).cast("long").alias("sub"), F.when((F.least(e["end"], b) > F.greatest(e["start"], a)), F.concat_ws("\t", "chrom", F.lit(source), name, (F.greatest(e["start"], a) + 1).cast("string"), F.least(e["end"], b).cast("string"), F.lit("."), "strand", F.lit("."), ids)).alias("line"))), lambda r: r["line"].isNotNull())
        rows = F.when(coded, F.concat(rows, cds, codon, utr(five, start, lo, 30_000), utr(three, hi, end, 40_000))).otherwise(rows)
    return models.select("ord", F.explode(rows).alias("r")).select("ord", "r.sub", "r.line")


def bedgraph_lines(segments: DataFrame) -> DataFrame:
    """Lines of (chrom, start, end, value) segments, values with six decimals."""
    return segments.select("chrom", "start", F.format_string("%s\t%d\t%d\t%.6f", "chrom", "start", "end", F.col("value").cast("double")).alias("line"))


def count_text(n: Column) -> Column:
    """A whole number where within 1e-4 of one, else up to six decimals without trailing zeros."""
    near = F.round(n)
    plain = F.regexp_replace(F.format_string("%.6f", n), r"\.?0+$", "")
    return F.when(F.abs(n - near) < 1e-4, near.cast("long").cast("string")).otherwise(plain)


@F.udf(StringType())
def _scientific(value: float | None) -> str | None:
    if value is None or not math.isfinite(value):
        return ""
    mantissa, exponent = f"{value:.6e}".split("e")
    return f"{mantissa}e{int(exponent)}"


def scientific(column: Column) -> Column:
    """Six decimals and a bare exponent (``1.000000e0``); empty where not finite."""
    return _scientific(column.cast("double"))


def decimals(column: Column) -> Column:
    """Six decimals; empty where missing or not finite."""
    v = column.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "").otherwise(F.format_string("%.6f", v))


#: The columns of the differential usage table, in order; those after the bar in exponent form.
USAGE_COLUMNS = "gene isoform pct1 pct2 logFC p_gene pct_diff p_gene_adj alpha1 alpha2 TU1 TU2 TU_diff TU_var1 TU_var2 dispersion1 dispersion2 isoform_switch isoform_switch_ES p_DTU_gene p_transcript p_transcript_adj p_DTU_gene_adj".split()


def usage_lines(usage: DataFrame) -> DataFrame:
    """(gene, isoform, line) of a differential usage frame."""
    def cell(name: str) -> Column:
        if name in ("gene", "isoform"):
            return F.coalesce(F.col(name), F.lit(""))
        if name == "isoform_switch":
            return F.coalesce(F.upper(F.col(name).cast("string")), F.lit(""))
        return scientific(F.col(name)) if name.startswith("p_") else decimals(F.col(name))

    return usage.select("gene", "isoform", F.concat_ws("\t", *map(cell, USAGE_COLUMNS)).alias("line"))


def matrix_lines(counts: DataFrame, features: list[str]) -> DataFrame:
    """(cell, line): zero-filled CSV rows of a long (cell, feature, n) frame over the given feature columns."""
    wide = counts.groupBy("cell").pivot("feature", features).agg(F.sum("n")).na.fill(0)
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return wide.select("cell", F.concat_ws(",", quoted(F.col("cell")), *[F.col(f"`{f}`").cast("string") for f in features]).alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Part files of the column ``line``, each sorted and all in order."""
    lines.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def single_file(lines: DataFrame, path: str, *order: str, header: str | None = None) -> None:
    """One file on the driver's side, a partition at a time."""
    with open(path, "w", encoding="utf-8", newline="") as out:
        if header is not None:
            out.write(header + "\n")
        for row in lines.orderBy(*order).select("line").toLocalIterator():
            out.write(row[0] + "\n")


def byte_offsets(lines: DataFrame, *order: str) -> DataFrame:
    """Each line's first byte in the joined file, over an ordered frame small enough for one window per file."""
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
