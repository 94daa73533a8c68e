"""Transcript models from aligned reads: error walk, filters, loci, genes, models."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.text import reverse_complement
from ..kernels import alignment_errors as errors
from ..kernels.collapse import CollapseSettings, Read, collapse_gene, genes_of
from ..kernels.models import Model
from .groups import keep_best_passing
from .intervals import cluster_intervals

PIECE = 100_000


@dataclass(frozen=True)
class ReadSettings:
    """Thresholds in percent (reads below go), the junction window, and how many errors beside a junction are too many."""

    coverage: float = 99.0
    identity: float = 85.0
    over_read: bool = True
    junction_window: int = 10
    junction_errors: int = 1000
    match: str = "_"
    models: CollapseSettings = field(default_factory=CollapseSettings)


def genome_pieces(fasta: DataFrame, width: int = PIECE) -> DataFrame:
    """(scaffold, piece, seq): the genome in pieces, so that no row and no broadcast holds a chromosome."""
    n = F.ceil(F.length("seq") / width).cast("int")
    numbered = fasta.where(F.length("seq") > 0).select(F.col("id").alias("scaffold"), "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return numbered.select("scaffold", F.col("piece").cast("long").alias("piece"), F.substring("seq", F.col("piece") * width + 1, F.lit(width)).alias("seq"))


def with_reference(reads: DataFrame, pieces: DataFrame, *, key: list[str], scaffold: str, low: str, high: str, width: int = PIECE) -> DataFrame:
    """Adds ``ref`` (the genome over [low, high), as far as it goes) and ``ref_start``."""
    wanted = reads.select(*key, F.col(scaffold).alias("scaffold"), F.greatest(low, F.lit(0)).alias("_lo"), F.col(high).alias("_hi"))
    dealt = wanted.withColumn("piece", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.greatest(F.col("_hi") - 1, F.col("_lo")) / width))))
    joined = dealt.join(pieces, ["scaffold", "piece"])
    first = F.greatest(F.col("_lo") - F.col("piece") * width, F.lit(0)).cast("int")
    cut = F.substring("seq", first + 1, (F.least(F.col("_hi") - F.col("piece") * width, F.lit(width)) - first).cast("int"))
    glued = joined.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", cut.alias("cut")))), lambda p: p["cut"]), "").alias("ref"), F.min("_lo").alias("ref_start"))
    return reads.join(glued, key, "left")


_WALKED = "path string, line long, cigar string, read_id string, scaffold string, strand string, start long, end long, starts array<long>, ends array<long>, before array<string>, after array<string>, length long, hard long, soft long, inserted long, deleted long, mismatched long, bad_sides long, density string, events array<struct<pos:bigint,kind:string,seq:string>>"
_NAMES = [c.split()[0] for c in _WALKED.replace("array<struct<pos:bigint,kind:string,seq:string>>", "x").split(", ")]


def walked_reads(alignments: DataFrame, fasta: DataFrame, settings: ReadSettings = ReadSettings()) -> DataFrame:
    """Primary alignments of the strict reader with their errors, junction tokens and variant events.

    Coordinates: ``start`` 1-based, ends exclusive in the same system, as the models have them.
    """
    rows = alignments.where(F.col("class").isin("forward", "reverse")).withColumn("ops", C.operations(F.col("cigar"))).withColumn("exons", C.exons(F.col("pos"), F.col("ops")))
    rows = rows.withColumn("end", F.element_at("exons", -1)["end"]).withColumn("low", F.col("pos") - 1)
    rows = with_reference(rows, genome_pieces(fasta), key=["path", "line"], scaffold="rname", low="low", high="end")

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                ops = [(o["len"], o["op"]) for o in r.ops]
                strand = "+" if r.kind == "forward" else "-"
                found = errors.walk(int(r.pos), ops, r.seq, _Shifted(r.ref or "", int(r.low)), settings.junction_window)
                starts, ends = [e["start"] for e in r.exons], [e["end"] for e in r.exons]
                near = errors.density(found.before, found.after, strand, settings.junction_window, settings.junction_errors, settings.match)
                hard, soft, inserted, deleted, mismatched = (found.counts[k] for k in "HSIDX")
                out.append((r.path, r.line, r.cigar, r.qname, r.rname, strand, r.pos, r.end, starts, ends, found.before, found.after, len(r.seq) + hard, hard, soft, inserted, deleted, mismatched, near["bad_sides"], "\t".join(near[k] for k in ("junctions", "totals", "profiles", "tokens", "pictures")), [{"pos": p, "kind": k, "seq": s} for p, k, s in found.events]))
            yield pd.DataFrame(out, columns=_NAMES)

    return rows.select("path", "line", "cigar", "qname", "rname", "pos", "end", "low", "seq", "ops", "exons", "ref", F.col("class").alias("kind")).mapInPandas(run, _WALKED)


class _Shifted:
    """A stretch of a sequence that answers to the whole sequence's coordinates."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def __len__(self) -> int:
        return self.at + len(self.text)

    def __getitem__(self, part: slice) -> str:
        return self.text[part.start - self.at : part.stop - self.at]


def judged_reads(walked: DataFrame, settings: ReadSettings = ReadSettings()) -> DataFrame:
    """``walked`` with coverage, identity and verdict: discarded below a threshold, else local_density_error, else accepted."""
    c = lambda name: F.col(name).cast("double")
    rows = walked.withColumn("coverage", C.coverage_percent(c("length"), c("hard"), c("soft"))).withColumn("identity", C.identity_percent(c("length"), c("hard"), c("soft"), c("inserted"), c("deleted"), c("mismatched"), over_read=settings.over_read))
    enough = (F.col("coverage") >= settings.coverage) & (F.col("identity") >= settings.identity)
    return rows.withColumn("verdict", F.when(~F.coalesce(enough, F.lit(False)), "discarded").when(F.col("bad_sides") > 0, "local_density_error").otherwise("accepted"))


def best_accepted(judged: DataFrame, settings: ReadSettings = ReadSettings()) -> DataFrame:
    """Of a read's accepted alignments the best covered passing one, else the first in the files."""
    passing = (F.col("coverage") > settings.coverage) & (F.col("identity") > settings.identity)
    rows = judged.where("verdict = 'accepted'").withColumn("_at", F.struct("path", "line"))
    return keep_best_passing(rows, ["read_id"], passing, "coverage", "_at").drop("_at")


def accepted_reads(walked: DataFrame, settings: ReadSettings = ReadSettings()) -> DataFrame:
    """Reads at or above the thresholds and without dense junction errors; of a read's alignments the best covered passing one."""
    return best_accepted(judged_reads(walked, settings), settings)


_MODELS = "scaffold string, locus long, strand string, gene long, model long, gene_start long, starts array<long>, ends array<long>, reads array<string>, start_wobble array<long>, end_wobble array<long>, start_rank array<long>, end_rank array<long>, start_tokens array<string>, end_tokens array<string>"


def models_of(reads: DataFrame, settings: ReadSettings = ReadSettings()) -> DataFrame:
    """Models by locus (reads that overlap or touch), strand and gene; one kernel call a locus and strand."""
    loci = cluster_intervals(reads, ["scaffold"], "start", "end", ["end", "read_id"], touching=True, out="locus")
    columns = [c.split()[0] for c in _MODELS.split(", ")]
    options = settings.models

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("read_id")
        own = [Read(r.read_id, Model(r.strand, tuple(zip(r.starts.tolist(), r.ends.tolist(), strict=True))), tuple(r.before), tuple(r.after)) for r in frame.itertuples(index=False)]
        out = []
        for g, members in enumerate(genes_of([r.model for r in own]), 1):
            reads_of_gene = [own[k] for k in members]
            start = min(r.model.exons[0][0] for r in reads_of_gene)
            for k, m in enumerate(collapse_gene(reads_of_gene, options), 1):
                out.append((frame.scaffold.iloc[0], frame.locus.iloc[0], frame.strand.iloc[0], g, k, start, [s for s, _ in m.exons], [e for _, e in m.exons], m.reads, m.start_wobble, m.end_wobble, m.start_rank, m.end_rank, m.start_tokens, m.end_tokens))
        return pd.DataFrame(out, columns=columns)

    return loci.select("scaffold", "locus", "strand", "read_id", "starts", "ends", "before", "after").groupBy("scaffold", "locus", "strand").applyInPandas(run, _MODELS)


def numbered_models(models: DataFrame) -> DataFrame:
    """Gene and model names ``Gn`` and ``Gn.k``: genes in order of scaffold and start, + before - at one start.

    Numbers are local to a scaffold plus the genes of the scaffolds before it, so no window runs over all genes.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("scaffold").orderBy("gene_start", "strand", "locus", "gene")
    ranked = models.withColumn("_local", F.dense_rank().over(by))
    sizes = ranked.groupBy("scaffold").agg(F.max("_local").alias("_n"))
    before = sizes.select("scaffold", F.coalesce(F.sum("_n").over(Window.orderBy("scaffold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    named = ranked.join(F.broadcast(before), "scaffold").withColumn("gene_id", F.concat(F.lit("G"), (F.col("_local") + F.col("_before")).cast("string")))
    return named.withColumn("model_id", F.concat_ws(".", "gene_id", F.col("model").cast("string"))).drop("_local", "_before")


def variant_events(walked: DataFrame) -> DataFrame:
    """(scaffold, read_id, pos, kind, seq): what the walk found, of discarded reads too."""
    return walked.select("scaffold", "read_id", F.explode("events").alias("e")).select("scaffold", "read_id", "e.*")


def reads_over(places: DataFrame, accepted: DataFrame) -> DataFrame:
    """(scaffold, pos, read_id): the accepted reads with an exon over each distinct place.

    Exons count from 1 and places from 0, and both are compared as they are: a read does not cover the
    base that it starts at, and covers the one after its exon's last.
    """
    from .intervals import interval_join

    exons = accepted.select("scaffold", "read_id", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("scaffold", "read_id", F.col("x.starts").alias("a"), F.col("x.ends").alias("b"))
    spans = places.withColumn("pos_end", F.col("pos") + 1)
    return interval_join(exons, spans, ["scaffold"], width=10_000, left_span=("a", "b"), right_span=("pos", "pos_end")).select("scaffold", "pos", "read_id")


def supported_variants(walked: DataFrame, accepted: DataFrame, *, least: int = 5) -> DataFrame:
    """(scaffold, pos, kind, seq, support, cover): events of all walked reads with ``least`` reads or more, and the accepted reads over the place."""
    support = variant_events(walked).groupBy("scaffold", "pos", "kind", "seq").agg(F.countDistinct("read_id").alias("support")).where(F.col("support") >= least)
    cover = reads_over(support.select("scaffold", "pos").distinct(), accepted).groupBy("scaffold", "pos").agg(F.countDistinct("read_id").alias("cover"))
    return support.join(cover, ["scaffold", "pos"], "left").withColumn("cover", F.coalesce("cover", F.lit(0)))


def collapse(alignments: DataFrame, fasta: DataFrame, settings: ReadSettings = ReadSettings()) -> DataFrame:
    """Numbered models of the alignments."""
    return numbered_models(models_of(accepted_reads(walked_reads(alignments, fasta, settings), settings), settings))


def polya_windows(models: DataFrame, fasta: DataFrame, key: list[str], *, window: int = errors.POLYA_WINDOW) -> DataFrame:
    """Models (key, scaffold, strand, start, end) with polya_seq, a_count and a_share: the genome beyond the 3' end, read along the strand.

    Coordinates index the sequence as they are. Beyond the genome's ends the window is shorter;
    nothing of it left counts as a share of 0. A strand other than + and - is an error.
    """
    plus = F.col("strand") == "+"
    bad = F.raise_error(F.concat(F.lit("bad strand "), F.coalesce("strand", F.lit("null"))))
    low = F.when(plus, F.col("end")).when(F.col("strand") == "-", F.col("start") - window).otherwise(bad)
    high = F.when(plus, F.col("end") + window).otherwise(F.col("start"))
    placed = models.withColumn("_low", F.greatest(low, F.lit(0)).cast("long")).withColumn("_high", F.greatest(high, F.lit(0)).cast("long"))
    cut = with_reference(placed.where("_low < _high").select(*key, "scaffold", "_low", "_high"), genome_pieces(fasta), key=key, scaffold="scaffold", low="_low", high="_high").select(*key, "ref")
    found = placed.join(cut, key, "left").withColumn("ref", F.coalesce("ref", F.lit("")))
    seq = F.when(plus, F.col("ref")).otherwise(reverse_complement(F.col("ref")))
    told = found.withColumn("polya_seq", seq).withColumn("a_count", (F.length("polya_seq") - F.length(F.replace("polya_seq", F.lit("A"), F.lit("")))).cast("long"))
    return told.withColumn("a_share", F.col("a_count") / F.greatest(F.length("polya_seq"), F.lit(1))).drop("ref", "_low", "_high")
