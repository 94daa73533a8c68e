"""Selecting genes, transcripts and reads, checked lookups, and gathering of novel features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import two_decimals
from ..functions.text import reverse_complement, without_novel_suffix

#: The donor and acceptor pairs of a proper intron.
MOTIFS = ("GTAG", "GCAG", "ATAC")
BLOCK = 1 << 16


def subset_genes(genes: DataFrame, names: Sequence[str]) -> DataFrame:
    """The genes whose gene_name, gene_id or label is listed; a name no gene has is an error."""
    keys = F.array("gene_name", "gene_id", "label")
    listed = F.array(*(F.lit(n) for n in names)).cast("array<string>")
    kept = genes.where(F.arrays_overlap(keys, listed))
    found = kept.select(F.explode(F.array_intersect(keys, listed)).alias("name")).distinct().collect()  # at most one row a listed name
    missing = [n for n in names if n not in {r.name for r in found}]
    if missing:
        raise ValueError(f"genes that are not in the annotation: {', '.join(missing)}")
    return kept


def gather_novel(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Counts (cell, feature, n) with all novel features, of whatever gene, summed into one.

    ``features``: (feature, ord). The sum is named after the first novel feature without its number,
    or ``novel`` if nothing is left; a known feature of that name takes it in. A null feature stays.
    """
    novel = F.col("feature").contains("novel")
    first = features.where(novel).agg(F.min_by(without_novel_suffix(F.col("feature")), "ord").alias("name")).first().name
    named = F.when(novel, F.lit(first or "novel")).otherwise(F.col("feature"))
    return counts.withColumn("feature", named).groupBy("cell", "feature").agg(F.sum("n").alias("n"))


def with_sequence(isoforms: DataFrame, sequences: DataFrame, key: str = "id") -> DataFrame:
    """Isoforms with ``seq`` of (key, seq); an isoform without one is an error."""
    joined = isoforms.join(sequences.select(key, "seq"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no sequence for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("seq", F.coalesce("seq", missing))


def polya_report(reads: DataFrame, least: float = 70.0) -> DataFrame:
    """Reads whose window beyond the 3' end is A for more than ``least`` percent; a null share is not reported."""
    percent = F.col("a_share") * 100.0
    return reads.where(percent > least).select("read", "model", "strand", two_decimals(percent).alias("a_percent"), "a_count", "polya_seq")


def per_million(df: DataFrame, sample: str, value: str) -> DataFrame:
    """``value`` as parts per million of its sample's sum; values of a sample that sums to nothing stay."""
    total = df.groupBy(F.col(sample).alias("_sample")).agg(F.sum(value).alias("_total"))
    joined = df.join(total, F.col(sample).eqNullSafe(F.col("_sample")), "left")
    return joined.withColumn(value, F.when(F.col("_total") > 0, 1.0e6 * F.col(value) / F.col("_total")).otherwise(F.col(value))).select(*df.columns)


def sequence_blocks(genome: DataFrame, width: int = BLOCK) -> DataFrame:
    """(chrom, block, seq) of (chrom, seq), cut at multiples of ``width``, each with the next block's first letter."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chrom, seq in zip(frame.chrom, frame.seq, strict=True):
                starts = range(0, len(seq or ""), width)
                yield pd.DataFrame({"chrom": chrom, "block": range(len(starts)), "seq": [seq[s : s + width + 1] for s in starts]})

    return genome.where(F.length("seq") > 0).select("chrom", "seq").mapInPandas(cut, "chrom string, block long, seq string")


def intron_motifs(introns: DataFrame, genome: DataFrame, width: int = BLOCK) -> DataFrame:
    """``introns`` (chrom, start, end, strand) with ``motif``, its first and last two letters read along the strand.

    Letters come from blocks of the genome joined on (chrom, block), so no task holds a chromosome
    beyond the one that cuts it, and each place is looked up once. An intron of fewer than two
    letters and one outside the genome are errors.
    """
    place = F.explode(F.array("start", F.col("end") - 2)).alias("at")
    places = introns.select("chrom", place).distinct().withColumn("block", F.floor(F.col("at") / width).cast("long"))
    pairs = places.join(sequence_blocks(genome, width), ["chrom", "block"]).select("chrom", "at", F.substr("seq", (F.col("at") - F.col("block") * width + 1).cast("int"), F.lit(2)).alias("pair"))
    ends = introns.withColumn("_last", F.col("end") - 2)
    for column, at in (("_donor", "start"), ("_acceptor", "_last")):
        side = pairs.select("chrom", F.col("at").alias(at), F.col("pair").alias(column))
        ends = ends.join(side, ["chrom", at], "left")
    where = F.concat_ws(" ", F.lit(""), "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    motif = F.concat("_donor", "_acceptor")
    motif = F.when(F.col("end") - F.col("start") < 2, F.raise_error(F.concat(F.lit("intron of fewer than two letters:"), where))).when(motif.isNull() | (F.length(motif) < 4), F.raise_error(F.concat(F.lit("intron outside the genome:"), where))).otherwise(motif)
    motif = F.when(F.col("strand") == "-", reverse_complement(motif, other="strict")).otherwise(motif)
    return ends.withColumn("motif", motif).select(*introns.columns, "motif")


def transfrag_checks(frags: DataFrame, *, least_length: int, least_expr: float, genome: DataFrame | None = None, motifs: Sequence[str] = ()) -> DataFrame:
    """Transfrags (id, chrom, strand, exons, expr) with too_short, too_weak, bad_introns and keep.

    Length is the exons' sum. A transfrag that fails several rules is marked by each. Introns are
    judged only where a genome is given, against ``MOTIFS`` and ``motifs``. ids are unique.
    """
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda n, e: n + e["end"] - e["start"])
    marked = frags.withColumn("too_short", length < least_length).withColumn("too_weak", F.col("expr") < least_expr)
    if genome is None:
        bad = marked.withColumn("bad_introns", F.lit(0).cast("long"))
    else:
        gaps = F.transform(F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(0))), lambda e, i: F.struct(F.get(F.col("exons"), i)["end"].alias("start"), e["start"].alias("end")))
        introns = frags.select("id", "chrom", "strand", F.inline(gaps))
        distinct = intron_motifs(introns.drop("id").distinct(), genome).where(~F.col("motif").isin(*MOTIFS, *(m.upper() for m in motifs)))
        counted = introns.join(distinct, ["chrom", "strand", "start", "end"]).groupBy("id").agg(F.count(F.lit(1)).alias("bad_introns"))
        bad = marked.join(counted, "id", "left").na.fill(0, ["bad_introns"])
    return bad.withColumn("keep", ~F.col("too_short") & ~F.col("too_weak") & (F.col("bad_introns") == 0))
