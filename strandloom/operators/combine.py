"""One set of isoforms from several samples' sets, by intron chain and ends."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ten_thousands
from ..kernels.ends import CombineSettings, Isoform, combine_chain
from .ordinals import global_row_number


@dataclass(frozen=True)
class Combined:
    """``bed``: rows of kept isoforms; ``members``: (name, place, source id); ``support``: (name, place, sample, counts)."""

    bed: DataFrame
    members: DataFrame
    support: DataFrame


def _locus(bed_has_introns, free_start, free_end):
    body = F.when(bed_has_introns, F.transform(F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(0))), lambda e, i: F.struct(F.element_at("exons", (i + 1).cast("int"))["end"].alias("start"), e["start"].alias("end"))))
    bucket = F.when(~bed_has_introns, F.concat_ws("-", "chrom", ten_thousands(F.col("start")).cast("string")))
    return F.struct("chrom", "strand", free_start.alias("start"), free_end.alias("end"), body.alias("introns"), bucket.alias("bucket"))


def isoform_chains(bed: DataFrame, *, single_exon: bool = True) -> DataFrame:
    """(sample, ord, name, start, end, fusion, loci) of plain isoforms: ``loci`` is the chain, its own ends left open."""
    spliced = F.size("exons") > 1
    rows = bed if single_exon else bed.where(spliced)
    none = F.lit(None).cast("long")
    return rows.select("sample", "ord", F.replace("name", F.lit("_PAR_Y"), F.lit("")).alias("name"), F.col("name").alias("raw"), "start", "end", F.lit(False).alias("fusion"), F.array(_locus(spliced, none, none)).alias("loci"))


def fusion_chains(bed: DataFrame) -> DataFrame:
    """The same of fusions: a sample's rows with one name after the first ``_``, in order; the outer ends are left open."""
    rows = bed.withColumn("raw", F.array_join(F.slice(F.split("name", "_"), 2, 1 << 20), "_")).withColumn("locus", _locus(F.size("exons") > 1, F.col("start"), F.col("end")))
    grouped = rows.groupBy("sample", "raw").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "locus"))), lambda x: x["locus"]).alias("all"))
    first, last = F.element_at("all", 1), F.element_at("all", -1)
    n = F.size("all")

    def opened(locus, i):
        at_first, at_last = i == 0, i == n - 1
        forward = locus["strand"] == "+"
        lost_start = (at_first & forward) | (at_last & ~forward)
        lost_end = (at_first & ~forward) | (at_last & forward)
        return F.struct(locus["chrom"].alias("chrom"), locus["strand"].alias("strand"), F.when(~lost_start, locus["start"]).alias("start"), F.when(~lost_end, locus["end"]).alias("end"), locus["introns"].alias("introns"), locus["bucket"].alias("bucket"))

    start = F.when(first["strand"] == "+", first["start"]).otherwise(first["end"])
    end = F.when(last["strand"] == "+", last["end"]).otherwise(last["start"])
    return grouped.select("sample", "ord", F.replace("raw", F.lit("_PAR_Y"), F.lit("")).alias("name"), "raw", start.alias("start"), end.alias("end"), F.lit(True).alias("fusion"), F.transform("all", opened).alias("loci"))


def with_usage(chains: DataFrame, by_isoform: DataFrame | None, by_gene: DataFrame | None) -> DataFrame:
    """Adds usage (reads of the isoform over those of its gene) and counts; 1 and 1 without read maps, an error where a map lacks the isoform.

    ``by_isoform``: (sample, isoform, n); ``by_gene``: (sample, gene, n).
    """
    if by_isoform is None:
        return chains.withColumn("usage", F.lit(1.0)).withColumn("counts", F.lit(1).cast("long"))
    own = by_isoform.select("sample", F.col("isoform").alias("raw"), F.col("n").alias("counts"))
    all_ = by_gene.select("sample", F.col("gene").alias("_gene"), F.col("n").alias("_all"))
    joined = chains.withColumn("_gene", F.substring_index("raw", "_", -1)).join(own, ["sample", "raw"], "left").join(all_, ["sample", "_gene"], "left")
    missing = F.raise_error(F.concat(F.lit("no reads for "), F.col("raw")))
    return joined.withColumn("usage", F.when(F.col("counts").isNull(), missing).otherwise(F.col("counts") / F.col("_all"))).drop("_gene", "_all")


_ROWS = "chain long, kept boolean, tail_name string, end_number long, name string, keep boolean, start long, end long, rep_sample string, rep_name string, samples array<string>, members array<string>, counts array<long>"


def combine(isoforms: DataFrame, settings: CombineSettings = CombineSettings()) -> Combined:
    """Combine (sample, ord, name, start, end, fusion, loci, usage, counts); ``ord`` is the place over all samples, in order.

    Chains are numbered in order of their first isoform; only chains that keep something get a
    number. A chain too weak to keep is gathered under the name of the chain before it (an
    inherited rule); if it is the very first, that is an error.
    """
    keyed = isoforms.withColumn("_key", F.struct("fusion", "loci"))
    chains = keyed.groupBy("_key").agg(F.min("ord").alias("chain"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame["_key"].iloc[0]
        loci = key["loci"]
        fusion = bool(key["fusion"])
        single = not fusion and loci[0]["introns"] is None
        members = [Isoform(int(r.start), int(r.end), r.sample, r.name, float(r.usage), int(r.counts)) for r in frame.sort_values("ord").itertuples(index=False, name="Row")]
        found = combine_chain(members, settings, fusion=fusion, single=single)
        out = [(int(frame.chain.iloc[0]), found.kept, found.tail_name, k, tail, keep, rep.start, rep.end, rep.sample, rep.name, [m.sample for m in own], [m.name for m in own], [m.counts for m in own]) for k, tail, keep, rep, own in found.rows]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ROWS.split(", ")])

    rows = keyed.join(chains, "_key").groupBy("_key").applyInPandas(run, _ROWS)
    each = rows.groupBy("chain").agg(F.first("kept").alias("kept"), F.first("tail_name").alias("tail_name"))
    placed = global_row_number(each, "chain", [], out="place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("tail_name").alias("before"))
    numbered = placed.join(before, "place", "left").join(global_row_number(each.where("kept").select("chain"), "chain", [], out="number"), "chain", "left").drop("kept", "tail_name")
    named = rows.join(numbered, "chain")
    number = F.col("number").cast("string")
    weak = F.when(F.col("before").isNull(), F.raise_error(F.lit("the first chain is too weak to keep and has none before it to be named after"))).otherwise(F.col("before"))
    name = F.when(~F.col("kept"), weak).when(~F.col("keep"), F.col("name")).when(F.col("name").startswith("="), F.concat(number, F.substring("name", 2, 1 << 30))).otherwise(F.concat(F.lit(settings.prefix), number, "name"))
    named = named.withColumn("name", name)
    loci = chains.select("chain", F.col("_key.loci").alias("loci"))
    bed = _bed_rows(named.where("kept AND keep").join(loci, "chain"))
    flat = named.select("chain", "end_number", "name", "kept", F.posexplode(F.arrays_zip("samples", "members", "counts")).alias("at", "m"))
    place = F.struct("chain", "end_number", "at")
    members = flat.select("name", place.alias("place"), F.concat("m.samples", F.lit(".."), "m.members").alias("source"))
    support = flat.where("kept").select("name", place.alias("place"), F.col("m.samples").alias("sample"), F.col("m.counts").alias("counts"))
    return Combined(bed, members, support)


def _bed_rows(kept: DataFrame) -> DataFrame:
    """A row a locus: open ends are the representative's, blocks lie between the introns."""
    n = F.size("loci")
    exploded = kept.select("chain", "end_number", "name", "rep_sample", "rep_name", F.col("start").alias("r_start"), F.col("end").alias("r_end"), n.alias("n"), F.posexplode("loci").alias("pos", "locus"))
    forward = F.col("locus.strand") == "+"
    first, last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    plain = F.col("locus.start").isNull() & F.col("locus.end").isNull() & (F.col("n") == 1)
    start = F.when(plain, F.col("r_start")).when(last & ~forward, F.col("r_end")).when(first & forward, F.col("r_start")).otherwise(F.col("locus.start"))
    end = F.when(plain, F.col("r_end")).when(last & forward, F.col("r_end")).when(first & ~forward, F.col("r_start")).otherwise(F.col("locus.end"))
    exploded = exploded.withColumn("start", start).withColumn("end", end)
    introns = F.coalesce("locus.introns", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)"))
    edges = F.concat(F.array("start"), F.flatten(F.transform(introns, lambda i: F.array(i["start"], i["end"]))), F.array("end"))
    exons = F.transform(F.sequence(F.lit(0), F.size(introns)), lambda k: F.struct(F.element_at(edges, (2 * k + 1).cast("int")).alias("start"), F.element_at(edges, (2 * k + 2).cast("int")).alias("end")))
    name = F.when(F.col("n") > 1, F.concat(F.lit("fusiongene"), (F.col("pos") + 1).cast("string"), F.lit("_"), "name")).otherwise(F.col("name"))
    return exploded.select("chain", "end_number", "pos", name.alias("name"), F.col("locus.chrom").alias("chrom"), F.col("locus.strand").alias("strand"), exons.alias("exons"), "rep_sample", "rep_name")


def member_lists(combined: Combined) -> DataFrame:
    """(name, place, members): each name's sources in order, names in order of their first."""
    return combined.members.groupBy("name").agg(F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("members"))


def support_table(combined: Combined, samples: list[str]) -> DataFrame:
    """(name, place, one column a sample): summed counts, zero-filled."""
    first = combined.support.groupBy("name").agg(F.min("place").alias("place"))
    return combined.support.groupBy("name").pivot("sample", samples).agg(F.sum("counts")).na.fill(0).join(first, "name")
