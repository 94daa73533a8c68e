"""Result files of collapsing reads to models, as lines for ``write_files``: ten files that tasks write and Spark commits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import double_text, two_decimals
from ..operators.collapse import (
    PIECE,
    ReadSettings,
    best_accepted,
    genome_pieces,
    judged_reads,
    models_of,
    numbered_models,
    polya_windows,
    reads_over,
    variant_events,
    walked_reads,
)
from ..operators.staging import staged
from .files import write_files
from .text import SOURCE_COLOURS, bed12_line

#: File endings, header lines, the labels of alignment classes, the order of variant kinds, the score of every row.
FILES = (".bed", "_read.txt", "_trans_report.txt", "_trans_read.bed", "_polya.txt", "_strand_check.txt", "_local_density_error.txt", "_variants.txt", "_varcov.txt", "_report.txt")
HEADERS = {
    "_read.txt": "read_id\tmapped_flag\taccept_flag\tpercent_coverage\tpercent_identity\terror_line<h;s;i;d;m>\tlength\tcigar",
    "_trans_report.txt": "transcript_id\tnum_clusters\thigh_coverage\tlow_coverage\thigh_quality_percent\tlow_quality_percent\tstart_wobble_list\tend_wobble_list\tcollapse_sj_start_err\tcollapse_sj_end_err\tcollapse_error_nuc",
    "_polya.txt": "cluster_id\ttrans_id\tstrand\ta_percent\ta_count\tsequence",
    "_strand_check.txt": "read_id\tscaff_name\tstart_pos\tcigar\tstrands",
    "_local_density_error.txt": "cluster_id\tlde_flag\tscaff_name\tstart_pos\tend_pos\tstrand\tnum_exons\tbad_sj_num_line\tbad_sj_error_count_line\tsj_error_profile_idmsh\tsj_error_nuc\tsj_error_simple\tcigar",
    "_variants.txt": "scaffold\tposition\ttype\tref_allele\talt_allele\tcount\tcov_count\tcluster_list",
    "_varcov.txt": "positions\toverlap_clusters",
}
LABELS = {"forward": "forward_strand", "reverse": "reverse_strand", "unmapped": "unmapped", "chimeric": "chimeric", "not_primary": "not_primary"}
KINDS = ("H", "S", "M", "I", "D")
SCORE = "40"
#: A genomic stretch beyond the 3' end with a higher share of A, in percent, is reported.
POLYA_PERCENT = 70.0


@dataclass(frozen=True)
class Collapsed:
    """The tables that the files are made of: all alignments, their verdicts, the reads in models, the models."""

    alignments: DataFrame
    judged: DataFrame
    accepted: DataFrame
    models: DataFrame


def collapsed(alignments: DataFrame, fasta: DataFrame, settings: ReadSettings = ReadSettings()) -> Collapsed:
    """Every table is written once, since several files read it and the walk over the errors is the dear part."""
    judged = staged(judged_reads(walked_reads(alignments, fasta, settings), settings), "judged")
    accepted = staged(best_accepted(judged, settings), "accepted")
    return Collapsed(alignments, judged, accepted, staged(numbered_models(models_of(accepted, settings)), "models"))


def _line(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cells))


def _percent(v: Column | str) -> Column:
    return double_text(two_decimals(F.col(v) if isinstance(v, str) else v))


def _block(strand_start: str, strand_end: str) -> Column:
    """Half-open exons of exons counted from 1."""
    return F.transform(F.arrays_zip(strand_start, strand_end), lambda e: F.struct((e[strand_start] - 1).alias("start"), (e[strand_end] - 1).alias("end")))


_ORDER = ("first", "second", "third", "sub")


def _of(suffix: str, df: DataFrame, line: Column, *order: Column | str | None) -> DataFrame:
    kinds = ("string", "long", "long", "string")
    cells = [*order, *[None] * (4 - len(order))]
    placed = [(F.col(c) if isinstance(c, str) else F.lit(c) if c is None else c).cast(k).alias(n) for c, k, n in zip(cells, kinds, _ORDER, strict=True)]
    return df.select(F.lit(suffix).alias("file"), *placed, line.alias("line"))


def read_lines(found: Collapsed) -> DataFrame:
    """Each alignment with its verdict; those that are not primary have no figures."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    others = found.alignments.where(~F.col("class").isin("forward", "reverse")).withColumn("_label", label[F.col("class")])
    errors = F.concat_ws(";", *(F.col(c).cast("string") for c in ("hard", "soft", "inserted", "deleted", "mismatched")))
    mapped = F.when(F.col("strand") == "+", LABELS["forward"]).otherwise(LABELS["reverse"])
    own = _of("_read.txt", found.judged, _line("read_id", mapped, "verdict", _percent("coverage"), _percent("identity"), errors, "length", "cigar"), "path", "line")
    return own.unionByName(_of("_read.txt", others, _line("qname", "_label", "_label", *[F.lit("NA")] * 5), "path", "line"))


def strand_lines(found: Collapsed) -> DataFrame:
    """Alignments whose spliced strand speaks against the strand they lie on."""
    signs = F.when((F.col("class") == "forward") & (F.col("xs") == "-"), "+-").when((F.col("class") == "reverse") & (F.col("xs") == "+"), "-+")
    rows = found.alignments.withColumn("_signs", signs).where(F.col("_signs").isNotNull())
    return _of("_strand_check.txt", rows, _line("qname", "rname", "pos", "cigar", "_signs"), "path", "line")


def density_lines(found: Collapsed) -> DataFrame:
    """Errors around the junctions of the alignments at or above the thresholds."""
    rows = found.judged.where("verdict <> 'discarded'")
    flag = F.when(F.col("bad_sides") == 0, "lde_pass").otherwise("lde_fail")
    return _of("_local_density_error.txt", rows, _line("read_id", flag, "scaffold", "start", "end", "strand", F.size("starts"), "density", "cigar"), "path", "line")


def model_lines(found: Collapsed, fasta: DataFrame) -> DataFrame:
    """Models, their reports, their reads, and reads whose 3' end lies before a stretch of A in the genome."""
    models = found.models.withColumn("_gene", F.substring("gene_id", 2, 20).cast("long"))
    place = ("_gene", "model")
    exons = lambda df: df.withColumn("_exons", _block("starts", "ends"))
    bed = lambda name: bed12_line(F.col("_exons"), chrom=F.col("scaffold"), name=name, score=F.lit(SCORE), strand=F.col("strand"), rgb=F.lit(SOURCE_COLOURS[0]))
    beds = _of(".bed", exons(models), bed(F.concat_ws(";", "gene_id", "model_id")), None, *place)

    members = models.select("model_id", *place, F.explode("reads").alias("read_id")).join(found.accepted, "read_id")
    kept = _of("_trans_read.bed", exons(members), bed(F.concat_ws(";", "model_id", "read_id")), None, *place, "read_id")
    tails = polya_windows(members.select("path", "line", "read_id", "model_id", *place, "scaffold", "strand", "start", "end"), fasta, ["path", "line"]).where(F.col("a_share") * 100.0 > POLYA_PERCENT)
    polya = _of("_polya.txt", tails, _line("read_id", "model_id", "strand", _percent(F.col("a_share") * 100.0), "a_count", "polya_seq"), None, *place, "read_id")

    extremes = members.groupBy("model_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("coverage", "identity") for n, f in (("high", F.max), ("low", F.min))))
    tokens = F.when(F.size("start_tokens") > 1, F.slice("start_tokens", 2, F.size("start_tokens"))).otherwise(F.col("start_tokens"))  # the first exon's start is no junction
    numbers = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    report = _line("model_id", F.size("reads"), *map(_percent, ("high_coverage", "low_coverage", "high_identity", "low_identity")), *map(numbers, ("start_wobble", "end_wobble", "start_rank", "end_rank")), F.array_join(tokens, ";"))
    reports = _of("_trans_report.txt", models.join(extremes, "model_id"), report, None, *place)
    return beds.unionByName(kept).unionByName(polya).unionByName(reports)


def variant_lines(found: Collapsed, fasta: DataFrame, *, least: int = 5) -> DataFrame:
    """Events of ``least`` reads or more inside the genome, and the places that share their set of reads.

    A place's reads are the accepted ones over it and those with an event there. A mismatch has a reference
    base only where no clip begins at its place.
    """
    events = variant_events(found.judged).distinct()
    sizes = fasta.select(F.col("id").alias("scaffold"), F.length("seq").alias("_size"))
    counted = events.groupBy("scaffold", "pos", "kind", "seq").agg(F.count(F.lit(1)).alias("support"), F.array_join(F.sort_array(F.collect_list("read_id")), ",").alias("ids"))
    strong = counted.where((F.col("support") >= least) & (F.col("pos") >= 0)).join(sizes, "scaffold").where("pos < _size").drop("_size")
    places = staged(strong.select("scaffold", "pos").distinct(), "places")
    at = events.join(places, ["scaffold", "pos"])
    clips = at.groupBy("scaffold", "pos").agg(F.max(F.col("kind").isin("H", "S")).alias("_clipped"))
    over = reads_over(places, found.accepted).unionByName(at.select("scaffold", "pos", "read_id")).distinct()
    cover = staged(over.groupBy("scaffold", "pos").agg(F.count(F.lit(1)).alias("cover"), F.array_join(F.sort_array(F.collect_list("read_id")), ",").alias("over")), "cover")

    pieces = genome_pieces(fasta)
    bases = places.withColumn("piece", F.floor(F.col("pos") / PIECE)).join(pieces, ["scaffold", "piece"]).select("scaffold", "pos", F.substr("seq", (F.col("pos") - F.col("piece") * PIECE + 1).cast("int"), F.lit(1)).alias("base"))
    told = strong.join(cover.drop("over"), ["scaffold", "pos"]).join(clips, ["scaffold", "pos"]).join(bases, ["scaffold", "pos"])
    base = F.when((F.col("kind") == "M") & ~F.col("_clipped"), F.col("base")).otherwise("NA")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    variants = _of("_variants.txt", told, _line("scaffold", "pos", "kind", base, "seq", "support", "cover", "ids"), "scaffold", "pos", rank, "seq")

    named = F.concat_ws("_", "scaffold", F.col("pos").cast("string"))
    sets = cover.groupBy("over").agg(F.array_join(F.sort_array(F.collect_list(named)), ",").alias("at"), F.min(F.struct("scaffold", "pos")).alias("first_at"))
    return variants.unionByName(_of("_varcov.txt", sets, _line("at", "over"), F.col("first_at.scaffold"), F.col("first_at.pos")))


def report_lines(found: Collapsed, *, title: str, parameters: str) -> DataFrame:
    """Title, parameters, and the numbers of genes, models, accepted and discarded alignments."""
    models = found.models.agg(F.countDistinct("gene_id").alias("genes"), F.count(F.lit(1)).alias("models"))
    accepted = found.judged.agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"))
    everything = found.alignments.agg(F.count(F.lit(1)).alias("everything"))
    one = models.withColumn("_k", F.lit(1)).join(accepted.withColumn("_k", F.lit(1)), "_k").join(everything.withColumn("_k", F.lit(1)), "_k")
    rows = F.array(F.lit(title), F.lit(f"Parameters used:\t{parameters}"), *(F.concat(F.lit(f"Total {n}:\t"), c.cast("string")) for n, c in (("Gene Count", F.col("genes")), ("Transcript Count", F.col("models")), ("Accepted Reads", F.col("accepted")), ("Discarded Reads", F.col("everything") - F.col("accepted")))))
    return _of("_report.txt", one.select(F.posexplode(rows).alias("at", "text")), F.col("text"), None, "at")


def collapse_lines(found: Collapsed, fasta: DataFrame, *, variants: bool = True, least: int = 5, title: str = "Collapse has run successfully!", parameters: str = "") -> DataFrame:
    """(file, order columns, line) of all files; without ``variants`` the two variant files stay away."""
    frames = [read_lines(found), strand_lines(found), density_lines(found), model_lines(found, fasta), report_lines(found, title=title, parameters=parameters)]
    if variants:
        frames.append(variant_lines(found, fasta, least=least))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def write_collapse(found: Collapsed, fasta: DataFrame, path: str, prefix: str = "collapsed", *, variants: bool = True, **options) -> Sequence[str]:
    """``<prefix>.bed`` and nine reports below ``path``, which must not exist; returns the file names."""
    files = [f"{prefix}{x}" for x in FILES if variants or x not in ("_variants.txt", "_varcov.txt")]
    lines = collapse_lines(found, fasta, variants=variants, **options).withColumn("file", F.concat(F.lit(prefix), "file"))
    write_files(lines, path, files, *_ORDER, headers={f"{prefix}{k}": v for k, v in HEADERS.items() if f"{prefix}{k}" in files})
    return files
