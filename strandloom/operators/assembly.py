"""Transcripts of several samples assembled to one set: loci, strands, splice graphs, isoforms and their numbers.

What can be relational is: samples are normalised and filtered, loci numbered, strands imputed by
rounds of interval joins, equal exon lists added up, and loci split into units whose exon lists
share no covered stretch, as components of an edge table. Only a unit's distinct exon lists reach
the kernel, one unit a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.isoforms import AssemblySettings, assemble
from ..kernels.loci import Transfrag, numbered_isoforms
from ..kernels.splice_graph import Frag
from .components import connected_components
from .intervals import cluster_intervals, interval_join
from .ordinals import global_row_number, running_total
from .scans import cluster_by_bins
from .selection import per_million, transfrag_checks
from .staging import staged

_PLACE = "part: int, graph_start: bigint, graph_end: bigint"
_KINDS = {
    "cover": "start: bigint, end: bigint, value: float",
    "node": f"{_PLACE}, start: bigint, end: bigint, least: float, most: float, mean: float, known_starts: array<bigint>, known_stops: array<bigint>",
    "change": f"{_PLACE}, pos: bigint, start: bigint, end: bigint, sign: double, p: double, ratio: double",
    "tried": f"{_PLACE}, at: int, k: bigint, k_most: bigint, transfrags: bigint, short: bigint, short_expr: double, lost_short: bigint, lost_short_expr: double, kmers: bigint, lost_kmers: bigint, total_expr: double, graph_expr: double, share: double, valid: boolean, score: bigint, chosen: boolean",
    "isoform": f"{_PLACE}, gene: int, rank: int, site: int, sites: int, exons: array<struct<start: bigint, end: bigint>>, flow: double, share: double, gene_share: double",
}
#: Bases of a bin, the part of a chromosome that one task scans.
BIN = 1 << 16
#: The most transfrags of a chromosome that one task assembles whole; longer ones go by tables.
WHOLE = 4096
#: Where a transfrag stands among those of its strand: those whose strand was given come first.
_ORDER = "struct<round: int, start: bigint, sample_ord: bigint, ord: bigint>"


@dataclass
class Assembly:
    """``frags`` with locus and strand, ``loci``, and what their graphs gave."""

    frags: DataFrame
    loci: DataFrame
    coverage: DataFrame
    junctions: DataFrame
    nodes: DataFrame
    changes: DataFrame
    tried: DataFrame
    isoforms: DataFrame


def checked_transfrags(frags: DataFrame, *, least_length: int = 200, least_expr: float = 0.5, **motifs) -> DataFrame:
    """Transfrags (sample, id, chrom, strand, exons, expr) with expression per million of their sample and the marks of ``transfrag_checks``."""
    return transfrag_checks(per_million(frags, "sample", "expr"), least_length=least_length, least_expr=least_expr, **motifs)


def sample_stats(checked: DataFrame) -> DataFrame:
    """Per sample: transfrags, and how many fail by length, by expression, and improper introns."""
    return checked.groupBy("sample").agg(F.count(F.lit(1)).alias("transfrags"), F.count_if("too_short").alias("short"), F.count_if("too_weak").alias("weak"), F.sum("bad_introns").alias("bad_introns"))


def with_loci(frags: DataFrame) -> DataFrame:
    """Transfrags with ``start``, ``end`` and ``locus``: spans that overlap, numbered from 1 by chromosome and start."""
    spanned = frags.withColumn("start", F.element_at("exons", 1)["start"]).withColumn("end", F.element_at("exons", -1)["end"])
    own = staged(cluster_by_bins(spanned, ["chrom"], "start", "end", ["sample_ord", "ord"], width=BIN, gap=-1, out="_own"), "assembly-loci")
    sizes = own.groupBy("chrom").agg(F.max("_own").alias("_n"))  # a row a chromosome
    before = sizes.select(F.col("chrom").alias("_chrom"), F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(before, F.col("chrom") == F.col("_chrom")).withColumn("locus", F.col("_own") + F.col("_before")).drop("_own", "_chrom", "_before")


def _covered(exons: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches that exons (keys, start, end) cover."""
    stretches = cluster_intervals(exons.select(*keys, "start", "end").distinct(), keys, "start", "end", ["end"], touching=True, out="_stretch")
    return stretches.groupBy(*keys, "_stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_stretch")


def impute_strands(frags: DataFrame, keys: list[str], *, width: int = 1 << 14) -> DataFrame:
    """Transfrags (id, keys, strand, exons) with a strand where they overlap exons of one strand only, and ``round``.

    In a round every unstranded transfrag that meets exons of just one strand takes it; in the next
    its exons count too. Rounds end when none takes a strand. Given strands have round 0; one that
    meets both strands, or none, stays without (round null if it had none). ids are unique. Only
    newly stranded exons are joined in a round, merged to covered stretches before, so that deep
    loci do not multiply.
    """
    stranded = F.col("strand").isin("+", "-")
    exons = frags.select("id", *keys, "strand", F.inline("exons")).where("start < end")
    pending = staged(exons.where(~stranded).drop("strand"), "strands-pending")
    front = staged(_covered(exons.where(stranded), [*keys, "strand"]), "strands-front")
    taken, turn = [], 0
    while True:
        turn += 1
        met = interval_join(pending, front.select(*keys, F.col("strand").alias("near"), F.col("start").alias("s"), F.col("end").alias("e")), keys, width=width, left_span=("start", "end"), right_span=("s", "e"))
        hit = staged(met.groupBy("id").agg(F.min("near").alias("low"), F.max("near").alias("high")), "strands-hit")
        new = hit.where("low = high").select("id", F.col("low").alias("_strand"), F.lit(turn).alias("_round"))
        if new.isEmpty():
            break
        taken.append(new)
        front = staged(_covered(pending.join(new, "id").withColumn("strand", F.col("_strand")), [*keys, "strand"]), "strands-front")
        pending = staged(pending.join(hit.select("id"), "id", "left_anti"), "strands-pending")
    known = F.when(stranded, 0)
    if not taken:
        return frags.withColumn("round", known)
    named = taken[0]
    for new in taken[1:]:
        named = named.unionByName(new)
    return frags.join(named, "id", "left").withColumn("strand", F.coalesce("_strand", "strand")).withColumn("round", F.coalesce("_round", known)).drop("_strand", "_round")


def with_units(frags: DataFrame, *, whole_loci: bool = False) -> DataFrame:
    """Transfrags with ``unit``: transfrags of a locus and strand that are linked by covered stretches they share.

    Exons that overlap or touch make a stretch, and an intron links two: the units are components
    of stretches. Graphs of different units have no node in common. ``whole_loci``: a unit a strand.
    """
    if whole_loci:
        return frags.withColumn("unit", F.lit(0).cast("long"))
    keys = ["locus", "strand"]
    exons = frags.select(*keys, F.inline("exons")).distinct()
    numbered = cluster_intervals(exons, keys, "start", "end", ["end"], touching=True, out="_stretch")
    strand = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(2)
    code = F.shiftleft(F.col("locus") * 3 + strand, 31) + F.col("_stretch")  # one long names locus, strand and stretch
    stretches = staged(numbered.select(*keys, "start", "end", code.alias("_node")), "units-stretches")
    gaps = F.transform(F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(0))), lambda e, i: F.struct(F.get(F.col("exons"), i).alias("x"), e.alias("y")))
    introns = frags.select(*keys, F.inline(gaps)).select(*keys, F.col("x.start").alias("s1"), F.col("x.end").alias("e1"), F.col("y.start").alias("s2"), F.col("y.end").alias("e2")).distinct()
    side = lambda k, name: stretches.select(*keys, F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}"), F.col("_node").alias(name))
    links = introns.join(side(1, "a"), [*keys, "s1", "e1"]).join(side(2, "b"), [*keys, "s2", "e2"]).where("a <> b")
    components = connected_components(links)
    named = stretches.join(components, stretches["_node"] == components["node"], "left").select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.coalesce("component", "_node").alias("unit"))
    first = frags.withColumn("_s", F.element_at("exons", 1)["start"]).withColumn("_e", F.element_at("exons", 1)["end"])
    return first.join(named, [*keys, "_s", "_e"]).drop("_s", "_e")


def _graphs(units: DataFrame, settings: AssemblySettings) -> DataFrame:
    """A row a unit: (chrom, locus, strand, unit, first) and an array of rows of each kind."""
    order = F.struct(F.coalesce("round", F.lit(0)).alias("round"), "start", "sample_ord", "ord")
    keys = ["chrom", "locus", "strand", "unit"]
    lists = units.groupBy(*keys, "exons", "is_ref").agg(F.min(order).alias("first"), F.sum("expr").alias("expr"), F.count(F.lit(1)).alias("n"))
    gathered = lists.groupBy(*keys).agg(F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("first", "exons", "is_ref", "expr", "n"))).alias("lists"))

    # units are small in bytes and long in work, so they are dealt out whatever their bytes
    dealt = gathered.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for strand, lists in zip(frame.strand, frame["lists"], strict=True):
                frags = [Frag([(int(e["start"]), int(e["end"])) for e in x["exons"]], float(x["expr"]), int(x["n"]), bool(x["is_ref"])) for x in lists]
                found = assemble(strand, frags, settings)
                sites = 0
                for row in found["isoform"]:
                    sites = max(sites, row["site"] + 1) if row["rank"] else 1
                    row["sites"] = sites
                rows.append([found[kind] for kind in _KINDS])
            made = pd.DataFrame(rows, columns=list(_KINDS))
            yield pd.concat([frame[[*keys, "first"]].reset_index(drop=True), made], axis=1)

    kinds = ", ".join(f"{kind} array<struct<{fields}>>" for kind, fields in _KINDS.items())
    return dealt.mapInPandas(run, f"chrom string, locus long, strand string, unit long, first {_ORDER}, {kinds}")


def strand_order(strand: Column) -> Column:
    return F.when(strand == "+", 0).when(strand == "-", 1).otherwise(2)


def assemble_transfrags(frags: DataFrame, settings: AssemblySettings = AssemblySettings()) -> Assembly:
    """Transfrags (sample_ord, ord, id, chrom, strand, exons, expr, is_ref) to loci, graphs and isoforms.

    Genes, transcript starts and transcripts are numbered from 1 through all loci, by locus, strand
    (+, -, none), the first transfrag of the graph's part, and falling flow. Rows without exons are
    left out. Expression of equal exon lists is summed before it is rounded to single precision.
    """
    located = with_loci(frags.where(F.size("exons") > 0))
    located = staged(impute_strands(located, ["chrom", "locus"]), "assembly-frags")
    guided = settings.guide.ends or settings.guide.assembly
    graphs = staged(_graphs(with_units(located, whole_loci=guided), settings), "assembly-graphs")
    rows = {kind: graphs.select("chrom", "locus", "strand", "first", F.inline(kind)) for kind in _KINDS}
    loci = located.groupBy("locus").agg(F.first("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    gaps = F.transform(F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(0))), lambda e, i: F.struct(F.get(F.col("exons"), i)["end"].alias("start"), e["start"].alias("end")))
    spliced = located.where(F.col("strand").isin("+", "-") & ~F.col("is_ref")).select("chrom", "strand", "expr", F.inline(gaps))
    junctions = spliced.groupBy("chrom", "start", "end", "strand").agg(F.sum("expr").alias("expr"))
    return Assembly(located, loci, rows["cover"], junctions, rows["node"], rows["change"], rows["tried"], _numbered(rows["isoform"]))


def assembled_isoforms(frags: DataFrame, settings: AssemblySettings = AssemblySettings()) -> DataFrame:
    """The isoforms of ``assemble_transfrags``, for many chromosomes of few transfrags: each of them is one task's work from its loci on.

    Numbers run along a chromosome first and are then shifted by those of the chromosomes before it;
    the chromosomes of more than ``WHOLE`` transfrags are assembled by tables and shifted likewise.
    """
    frags = staged(frags.where((F.size("exons") > 0) & F.col("chrom").isNotNull()), "assembly-input")
    deep = staged(frags.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("chrom"), "assembly-deep")
    none = deep.isEmpty()
    numbers = ["locus", "gene", "tss", "transcript"]
    found = staged(_whole(frags if none else frags.join(deep, "chrom", "left_anti"), settings), "assembly-whole")
    isoforms, sizes = found.where("strand <> ''"), found.where("strand = ''").select("chrom", *numbers)
    if not none:
        tabled = assemble_transfrags(frags.join(deep, "chrom"), settings)
        spans = tabled.loci.groupBy("chrom").agg(F.min("locus").alias("_locus"), F.max("locus").alias("_last"))
        starts = tabled.isoforms.groupBy("chrom").agg(*(f(k).alias(f"{name}{k}") for k in numbers[1:] for f, name in ((F.min, "_"), (F.max, "_last_"))))
        spans = staged(spans.join(starts, "chrom", "left"), "assembly-spans")
        own = tabled.isoforms.join(spans, "chrom").select("chrom", "strand", *((F.col(k) - F.col(f"_{k}") + 1).alias(k) for k in numbers), "exons", "flow", "share", "gene_share")
        isoforms = isoforms.unionByName(own)
        sizes = sizes.unionByName(spans.select("chrom", (F.col("_last") - F.col("_locus") + 1).alias("locus"), *(F.coalesce(F.col(f"_last_{k}") - F.col(f"_{k}") + 1, F.lit(0)).alias(k) for k in numbers[1:])))
    along = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)  # a row a chromosome
    before = sizes.select(F.col("chrom").alias("_chrom"), *(F.coalesce(F.sum(k).over(along), F.lit(0)).alias(f"_{k}") for k in numbers))
    shifted = isoforms.join(before, F.col("chrom") == F.col("_chrom"))
    return shifted.select("chrom", "strand", *((F.col(k) + F.col(f"_{k}")).alias(k) for k in numbers), "exons", "flow", "share", "gene_share")


def _whole(frags: DataFrame, settings: AssemblySettings) -> DataFrame:
    """Numbered isoforms of whole chromosomes, and for each one a row without a strand that has all its numbers."""
    fields = "chrom string, strand string, locus long, gene long, tss long, transcript long, exons array<struct<start: bigint, end: bigint>>, flow double, share double, gene_share double"
    exons = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.string(), pa.string(), *[pa.int64()] * 4, exons, *[pa.float64()] * 3]
    names = ["chrom", "strand", "locus", "gene", "tss", "transcript", "exons", "flow", "share", "gene_share"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Transfrag]]:
        for batch in batches:
            column = batch.column("exons")
            starts, ends = (column.flatten().field(k).to_pylist() for k in (0, 1))
            at = 0
            for n, chrom, strand, expr, sample, ord_, is_ref in zip(column.value_lengths().to_pylist(), *(batch.column(c).to_pylist() for c in ("chrom", "strand", "expr", "sample_ord", "ord", "is_ref")), strict=True):
                yield chrom, Transfrag(list(zip(starts[at : at + n], ends[at : at + n], strict=True)), strand, expr, (sample, ord_), is_ref)
                at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), types, strict=True)], names)
        for chrom, group in groupby(rows(batches), key=itemgetter(0)):
            for locus, gene, tss, transcript, strand, row in numbered_isoforms([f for _, f in group], settings):
                made.append((chrom, strand, locus, gene, tss, transcript, *(row.get(k) for k in names[-4:])))
            if len(made) > 1000:
                yield pack()
                made.clear()
        if made:
            yield pack()

    dealt = frags.select("chrom", "strand", "exons", F.col("expr").cast("double").alias("expr"), "sample_ord", "ord", "is_ref").repartition("chrom").sortWithinPartitions("chrom")
    return dealt.mapInArrow(run, fields)


def _numbered(isoforms: DataFrame) -> DataFrame:
    """Isoforms with transcript, gene and tss numbers, each counted through without a window over all rows."""
    ordered = global_row_number(isoforms, "locus", [strand_order(F.col("strand")), "first", "part", "gene", "rank"], out="transcript")
    ordered = staged(ordered.withColumn("_lead", (F.col("rank") == 0).cast("long")), "assembly-isoforms")
    genes = running_total(ordered, "transcript", "_lead", out="gene_number")
    # the sites of a gene are counted as they appear; what is counted at its last row is handed on
    new_site = F.when(F.col("rank") == 0, 1).otherwise(F.col("sites") - F.lag("sites").over(Window.partitionBy("gene_number").orderBy("rank")))
    counted = staged(genes.withColumn("_new", new_site.cast("long")), "assembly-isoforms")
    found = running_total(counted, "transcript", "_new", out="_upto").withColumn("tss", F.col("_upto") - F.col("sites") + F.col("site") + 1)
    return found.select("chrom", "strand", "locus", F.col("gene_number").alias("gene"), "tss", "transcript", "exons", "flow", "share", "gene_share")
