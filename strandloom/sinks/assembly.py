"""The result files of an assembly: transfrags, loci, coverage, junctions, graphs, statistics and isoforms as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import double_text, float_text
from ..functions.text import block_lists
from ..operators.assembly import Assembly, strand_order
from ..operators.ordinals import global_row_number, running_total
from .files import write_files

SOURCE = "strandloom"
#: The files of an assembly, in order, and the columns of the statistics of the k tried.
FILES = ("samples.txt", "sample_stats.txt", "transfrags.bed", "transfrags.filtered.bed", "loci.txt", "expr.pos.bedgraph", "expr.neg.bedgraph", "expr.none.bedgraph", "splice_junctions.bed", "splice_graph.gtf", "change_points.gtf", "path_graph_stats.txt", "assembly.gtf", "assembly.bed")
STATISTICS = "chrom start end strand k kmax transfrags short_transfrags short_expr lost_short lost_short_expr kmers lost_kmers tot_expr graph_expr expr_frac valid opt is_opt".split()
HEADERS = {
    "samples.txt": "gtf\tsample_id",
    "sample_stats.txt": "sample_id\tnum_transfrags\tfiltered_length\tfiltered_expr\tfiltered_splice",
    "splice_junctions.bed": 'track name=junctions description="Splice Junctions" graphType=junctions',
    "path_graph_stats.txt": "\t".join(STATISTICS),
}


def _tabbed(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cells))


def _attributes(**cells: Column) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit(f'{name} "'), value.cast("string"), F.lit('";')) for name, value in cells.items()))


def _gtf(feature: str, start: Column, end: Column, score: Column, source: str, attributes: Column) -> Column:
    return _tabbed("chrom", F.lit(source), F.lit(feature), start + 1, end, score, "strand", F.lit("."), attributes)


def transfrag_lines(frags: DataFrame) -> DataFrame:
    """Each transfrag with its BED ``line``."""
    start = F.element_at("exons", 1)["start"]
    sizes, starts = block_lists(F.col("exons"), start)
    zero = F.lit("0")
    return frags.withColumn("line", _tabbed("chrom", start, F.element_at("exons", -1)["end"], "id", double_text(F.col("expr")), "strand", zero, zero, zero, F.size("exons"), sizes, starts))


def locus_lines(found: Assembly) -> DataFrame:
    """(locus, chrom, start, line): span, first byte in the transfrags' file, and size of each locus."""
    placed = global_row_number(transfrag_lines(found.frags), "locus", ["start", "sample_ord", "ord"], out="_at")
    bytes_ = running_total(placed.select("locus", "_at", (F.octet_length("line") + 1).alias("_bytes")), "_at", "_bytes", out="_upto")
    first = bytes_.groupBy("locus").agg(F.min(F.col("_upto") - F.col("_bytes")).alias("offset"))
    return found.loci.join(first, "locus").select("locus", "chrom", "start", _tabbed(F.concat(F.lit("L"), F.col("locus")), "chrom", "start", "end", "offset", "n").alias("line"))


def junction_lines(junctions: DataFrame) -> DataFrame:
    left, right = F.col("start") - 1, F.col("end") + 1
    line = _tabbed("chrom", left, right, F.lit("JUNC"), double_text(F.col("expr")), "strand", left, right, F.lit("255,0,0"), F.lit("2"), F.lit("1,1"), F.concat(F.lit("0,"), F.col("end") + 1 - F.col("start")))
    return junctions.select("chrom", left.alias("start"), F.struct(F.col("end"), strand_order(F.col("strand")).alias("side")).alias("tie"), line.alias("line"))


def _graph_id() -> Column:
    return F.concat_ws("_", F.lit("G"), "chrom", F.col("graph_start").cast("string"), F.col("graph_end").cast("string"), "strand")


def node_lines(nodes: DataFrame, source: str = SOURCE) -> DataFrame:
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    cells = _attributes(graph_id=_graph_id(), expr_min=float_text(F.col("least")), expr_max=float_text(F.col("most")), expr_mean=float_text(F.col("mean")), ref_starts=listed("known_starts"), ref_stops=listed("known_stops"))
    return nodes.withColumn("line", _gtf("node", F.col("start"), F.col("end"), F.lit("0"), source, cells))


def change_lines(changes: DataFrame, source: str = SOURCE) -> DataFrame:
    """Two lines a change point: the point, and the slope it lies on."""
    cells = _attributes(graph_id=_graph_id(), sign=double_text(F.col("sign")), pvalue=double_text(F.col("p")), foldchange=float_text(F.col("ratio")))
    row = lambda sub, feature, a, b: F.struct(F.lit(sub).alias("sub"), a.alias("from"), _gtf(feature, a, b, F.lit("0"), source, F.col("_cells")).alias("line"))
    both = F.array(row(0, "changept", F.col("pos"), F.col("pos") + 1), row(1, "changeinterval", F.col("start"), F.col("end")))
    return changes.withColumn("_cells", cells).withColumn("_row", F.explode(both)).select("*", "_row.sub", "_row.from", "_row.line").drop("_row", "_cells")


def statistics_lines(tried: DataFrame) -> DataFrame:
    cells = ["chrom", "graph_start", "graph_end", "strand", "k", "k_most", "transfrags", "short", double_text(F.col("short_expr")), "lost_short", double_text(F.col("lost_short_expr")), "kmers", "lost_kmers", double_text(F.col("total_expr")), double_text(F.col("graph_expr")), double_text(F.col("share")), F.col("valid").cast("int"), "score", F.col("chosen").cast("int")]
    return tried.withColumn("line", _tabbed(*cells))


def isoform_lines(isoforms: DataFrame, samples: int, source: str = SOURCE) -> tuple[DataFrame, DataFrame]:
    """GTF lines (a transcript and its exons) and BED lines of the isoforms; expression is divided by the number of samples."""
    expr, score = F.col("flow") / samples, F.floor(1000 * F.col("share") + 0.5)
    ids = {"locus_id": F.concat(F.lit("L"), F.col("locus")), "gene_id": F.concat(F.lit("G"), F.col("gene")), "tss_id": F.concat(F.lit("TSS"), F.col("tss")), "transcript_id": F.concat(F.lit("TU"), F.col("transcript"))}
    fixed = lambda digits, v: F.format_string(f"%.{digits}f", v)
    whole = _attributes(expr=fixed(3, expr), rel_frac=fixed(5, F.col("share")), abs_frac=fixed(5, F.col("gene_share")), **ids)
    start, end = F.element_at("exons", 1)["start"], F.element_at("exons", -1)["end"]
    named = isoforms.withColumn("_ids", _attributes(**ids)).withColumn("_score", score)
    transcript = F.struct(F.lit(0).alias("sub"), start.alias("from"), _gtf("transcript", start, end, F.col("_score"), source, whole).alias("line"))
    exons = F.transform("exons", lambda e, i: F.struct((i + 1).alias("sub"), e["start"].alias("from"), _gtf("exon", e["start"], e["end"], F.col("_score"), source, F.col("_ids")).alias("line")))
    gtf = named.withColumn("_row", F.explode(F.concat(F.array(transcript), exons))).select("chrom", "transcript", "_row.sub", "_row.from", "_row.line")
    sizes, starts = block_lists(F.col("exons"), start)
    name = F.concat(ids["gene_id"], F.lit("|"), ids["transcript_id"], F.lit("("), fixed(1, expr), F.lit(")"))
    bed = isoforms.select("chrom", "transcript", start.alias("from"), _tabbed("chrom", start, end, name, score, "strand", start, start, F.lit("0"), F.size("exons"), F.concat(sizes, F.lit(",")), F.concat(starts, F.lit(","))).alias("line"))
    return gtf, bed


def assembly_lines(found: Assembly, checked: DataFrame, samples: DataFrame, stats: DataFrame, source: str = SOURCE) -> DataFrame:
    """(file, k1 ... k7, line) of all files of an assembly.

    ``samples``: (ord, path, sample) without the reference; ``checked``: all transfrags with ``keep``.
    Rows that share chromosome and start keep the order of loci, strands and transfrags.
    """
    def of(name: str | Column, df: DataFrame, chrom: str | None, start: Column | str, *more: Column | str) -> DataFrame:
        keys = [F.lit("") if chrom is None else F.col(chrom), *(F.col(c) if isinstance(c, str) else c for c in (start, *more))]
        keys = [k.cast("long") if n else k for n, k in enumerate(keys)] + [F.lit(0).cast("long")] * (7 - len(keys))
        return df.select((F.lit(name) if isinstance(name, str) else name).alias("file"), *(k.alias(f"k{n + 1}") for n, k in enumerate(keys)), "line")

    strand = strand_order(F.col("strand"))
    gtf, bed = isoform_lines(found.isoforms, samples.count(), source)
    graph = F.when(F.col("strand") == "+", "expr.pos.bedgraph").when(F.col("strand") == "-", "expr.neg.bedgraph").otherwise("expr.none.bedgraph")
    covered = found.coverage.withColumn("line", F.format_string("%s\t%d\t%d\t%.6f", "chrom", "start", "end", F.col("value").cast("double")))
    parts = [
        of("samples.txt", samples.withColumn("line", _tabbed("path", "sample")), None, "ord"),
        # by the id as text
        of("sample_stats.txt", stats.withColumn("line", _tabbed("sample", "transfrags", "short", "weak", "bad_introns")), "sample", F.lit(0)),
        of("transfrags.bed", transfrag_lines(found.frags), "chrom", "start", "sample_ord", "ord"),
        of("transfrags.filtered.bed", transfrag_lines(checked.where(~F.col("keep"))), None, "sample_ord", "ord"),
        of("loci.txt", locus_lines(found), None, "locus"),
        of(graph, covered, "chrom", "start"),
        of("splice_junctions.bed", junction_lines(found.junctions), "chrom", "start", "tie.end", "tie.side"),
        of("splice_graph.gtf", node_lines(found.nodes, source), "chrom", "start", "locus", strand, "part"),
        of("change_points.gtf", change_lines(found.changes, source), "chrom", "from", "locus", strand, "part", "pos", "sub"),
        of("path_graph_stats.txt", statistics_lines(found.tried), "chrom", "graph_start", "locus", strand, "part", "at"),
        of("assembly.gtf", gtf, "chrom", "from", F.least(F.col("sub"), F.lit(1)), "transcript", "sub"),
        of("assembly.bed", bed, "chrom", "from", "transcript"),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_assembly(found: Assembly, checked: DataFrame, samples: DataFrame, stats: DataFrame, path: str, source: str = SOURCE) -> None:
    """All files of an assembly below ``path``, which must not exist."""
    lines = assembly_lines(found, checked, samples, stats, source)
    write_files(lines, path, FILES, *(f"k{n}" for n in range(1, 8)), headers=HEADERS)
