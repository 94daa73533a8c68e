"""Molecules per cell, gene and isoform from aligned long reads."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..kernels import novel, placement
from ..kernels.placement import GeneModel, MatchSettings
from .groups import keep_best
from .intervals import cluster_intervals, interval_join

BUCKET = 100_000


@dataclass(frozen=True)
class QuantSettings:
    """Options of the quantification; ``platform``: 10x, 10x-hifi, parse or bulk."""

    platform: str = "10x"
    cell_tag: str = "CB"
    molecule_tag: str = "UB"
    match: MatchSettings = field(default_factory=MatchSettings)
    novel_reads: int = 10
    novel_share: float = 0.0
    group_novel: bool = True
    least_assigned: int = 10
    rounds: int = 50


def subexons(genes: DataFrame) -> DataFrame:
    """Adds ``bounds`` (disjoint covered pieces of all exons, in order) and ``rows`` (isoforms as lists of piece numbers).

    Isoforms come longest first (by pieces), then in file order, then by name.
    """
    flat = F.flatten(F.transform("isoforms", lambda i: i["exons"]))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform(flat, lambda e: F.array(e["start"], e["end"])))))
    pairs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    covered = F.filter(pairs, lambda p: F.exists(flat, lambda e: (e["start"] <= p["start"]) & (e["end"] >= p["end"])))
    out = genes.withColumn("bounds", covered)
    numbered = F.transform("bounds", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    rows = F.transform("isoforms", lambda iso: F.struct(iso["name"].alias("name"), iso["ord"].alias("ord"), F.transform(F.filter(numbered, lambda n: F.exists(iso["exons"], lambda e: (e["start"] <= n["p"]["start"]) & (e["end"] >= n["p"]["end"]))), lambda n: n["i"]).alias("pieces")))
    ordered = F.transform(F.array_sort(F.transform(rows, lambda r: F.struct((-F.size(r["pieces"])).alias("k"), r["ord"].alias("ord"), r["name"].alias("name"), r["pieces"].alias("pieces")))), lambda r: F.struct(r["name"].alias("name"), r["pieces"].alias("pieces")))
    return out.withColumn("rows", ordered)


def metagenes(genes: DataFrame) -> DataFrame:
    """(chrom, metagene, m_start, m_end, genes): overlapping or book-ended genes, in order."""
    clustered = cluster_intervals(genes, ["chrom"], "start", "end", ["end", "gene_id"], touching=True, out="metagene")
    models = F.array_sort(F.collect_list(F.struct("ord", "gene_id", "label", "start", "end", "strand", "bounds", "rows")))
    return clustered.groupBy("chrom", "metagene").agg(F.min("start").alias("m_start"), F.max("end").alias("m_end"), models.alias("genes"))


def molecules(reads: DataFrame, settings: QuantSettings) -> DataFrame:
    """One read of each molecule and sample: the longest aligned query, the first on ties. Unmapped and untagged reads go."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    sublibrary = F.coalesce(F.nullif(F.regexp_extract("path", r"sublibrary(\d*)[^/]*$", 1), F.lit("")), F.lit("1"))
    if settings.platform == "bulk":
        key, cell = F.col("qname"), F.translate("sample", ":", ".")
    elif settings.platform == "parse":
        p = F.split("qname", "_")
        n = F.size(p)
        cell = F.when(n >= 5, F.concat_ws("_", F.get(p, n - 5), F.get(p, n - 4), F.get(p, n - 3)))
        key = F.when(n >= 5, F.concat_ws("_", cell, F.get(p, n - 1), sublibrary))
    else:
        cell = tag(settings.cell_tag)
        key = text.read_identity(F.col("qname"), cell, tag(settings.molecule_tag), "10x")
    rows = reads.where(~F.col("unmapped")).withColumn("key", key).withColumn("cell", cell).where("key IS NOT NULL").withColumn("length", F.col("query_end") - F.col("query_start"))
    return keep_best(rows, ["sample", "key"], [F.desc("length"), F.asc("path"), F.asc("line")])


def _blocks(read) -> np.ndarray:
    at, out = read.start, []
    for length, op in ((o["len"], o["op"]) for o in read.ops):
        if op in "M=X":
            out.append((at, at + length))
        if op in "MDN=X":
            at += length
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _model(gene) -> GeneModel:
    bounds = np.array([(b["start"], b["end"]) for b in gene["bounds"]], dtype=np.int64).reshape(-1, 2)
    rows = np.zeros((len(gene["rows"]), len(bounds)), dtype=bool)
    for k, row in enumerate(gene["rows"]):
        rows[k, list(row["pieces"])] = True
    return GeneModel(gene["gene_id"], gene["start"], gene["end"], gene["strand"], bounds, rows)


def _tailed(read, gene: GeneModel, settings: QuantSettings) -> bool:
    """Whether the read has a true poly tail; ``near_end`` and ``near_start`` are the genome's 30 bases around its ends, if known."""
    if settings.platform != "10x-hifi":
        seq = read.seq or ""
        umi = (read.tags or {}).get("UR") or (read.tags or {}).get(settings.molecule_tag)
        seen = placement.molecule_tail(seq, read.query_start, read.query_end, umi) if settings.platform == "10x" else placement.edge_tail(seq, read.query_start, read.query_end)
        if not seen:
            return False
    near, base = (read.near_end, "A") if gene.strand == "+" else (read.near_start, "T")
    return near is None or placement.genomic_run(near, 0, len(near), base) < 8


def placements(kept: DataFrame, metas: DataFrame, settings: QuantSettings, genome: DataFrame | None = None) -> DataFrame:
    """Each molecule's gene and isoform: known before novel before none, then the better score, the longer gene, the smaller id.

    ``genome``: (id, seq). Only the bases around read ends are cut out of it, by a join.
    """
    reads = kept.select("sample", "path", "line", "qname", "cell", F.col("rname").alias("chrom"), "start", "end", "query_start", "query_end", "seq", "tags", "ops")
    if genome is not None:
        cut = lambda p: F.substring("g_seq", F.greatest(p - 15, F.lit(0)).cast("int") + 1, (p + 15 - F.greatest(p - 15, F.lit(0))).cast("int"))
        reads = reads.join(genome.select(F.col("id").alias("chrom"), F.col("seq").alias("g_seq")), "chrom", "left").withColumn("near_start", cut(F.col("start"))).withColumn("near_end", cut(F.col("end"))).drop("g_seq")
    else:
        reads = reads.withColumn("near_start", F.lit(None).cast("string")).withColumn("near_end", F.lit(None).cast("string"))
    pairs = interval_join(reads, metas, ["chrom"], width=BUCKET, left_span=("start", "end"), right_span=("m_start", "m_end"))

    def run(frames):
        models: dict[tuple, list[GeneModel]] = {}
        for frame in frames:
            out = []
            for read in frame.itertuples(index=False):
                own = models.get((read.chrom, read.metagene))
                if own is None:
                    if len(models) > 2000:
                        models.clear()
                    own = models[read.chrom, read.metagene] = [_model(g) for g in read.genes]
                found = placement.place(own, [_tailed(read, g, settings) for g in own], _blocks(read), read.start, read.end, settings.match)
                if found is not None:
                    k, kind, isoform, vector, score = found
                    gene = read.genes[k]
                    name = gene["rows"][isoform]["name"] if kind == placement.KNOWN else None
                    out.append((read.sample, read.path, read.line, read.qname, read.cell, gene["gene_id"], gene["label"], gene["strand"], gene["end"] - gene["start"], kind, name, None if vector is None else vector.tolist(), score, score if kind == placement.KNOWN else -2.0 if kind == placement.NOVEL else -3.0, read.metagene))
            yield pd.DataFrame(out, columns=["sample", "path", "line", "qname", "cell", "gene_id", "label", "strand", "gene_length", "kind", "isoform", "vector", "score", "priority", "metagene"])

    schema = "sample string, path string, line long, qname string, cell string, gene_id string, label string, strand string, gene_length long, kind string, isoform string, vector array<tinyint>, score double, priority double, metagene long"
    found = pairs.mapInPandas(run, schema)
    return keep_best(found, ["sample", "path", "line"], [F.desc("priority"), F.desc("gene_length"), F.asc("gene_id"), F.asc("metagene")])


def named_isoforms(hits: DataFrame, settings: QuantSettings) -> DataFrame:
    """The hits with ``isoform`` filled in: novel reads by discovery over all samples of a gene, weak novel isoforms set aside."""
    known = hits.where(F.col("kind") == placement.KNOWN).groupBy("gene_id").agg(F.count(F.lit(1)).alias("known"))
    new = hits.where(F.col("kind") == placement.NOVEL).join(known, "gene_id", "left")

    columns = hits.columns

    def run(gene: pd.DataFrame) -> pd.DataFrame:
        gene = gene.sort_values(["sample", "path", "line"], kind="stable")
        vectors = np.array(gene.vector.to_list(), dtype=np.int8)
        isoforms, calls = novel.discover(vectors, settings.least_assigned, settings.rounds)
        if settings.group_novel:
            to = novel.grouped(isoforms, "." if settings.platform == "parse" else gene.strand.iloc[0])
            calls = [to.get(c, c) for c in calls]
        support = pd.Series([c for c in calls if c is not None], dtype=object).value_counts()
        whole = int(support.sum()) + int(gene.known.fillna(0).iloc[0])
        weak = {n for n, k in support.items() if k < settings.novel_reads or settings.novel_share > 0 and k / whole < settings.novel_share}
        gene["isoform"] = ["uncategorized" if c is None else "uncategorized_novel" if c in weak else c for c in calls]
        return gene[columns]

    found = new.groupBy("gene_id").applyInPandas(run, hits.schema)
    rest = hits.where(F.col("kind") != placement.NOVEL).withColumn("isoform", F.coalesce("isoform", F.lit("uncategorized")))
    return rest.unionByName(found)


def molecule_counts(named: DataFrame) -> DataFrame:
    """(sample, cell, label, isoform, n)."""
    return named.groupBy("sample", "cell", "label", "isoform").agg(F.count(F.lit(1)).alias("n"))


def quantify(reads: DataFrame, genes: DataFrame, settings: QuantSettings = QuantSettings(), genome: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignments, counts) of rich alignments with a ``sample`` column over annotated genes."""
    metas = metagenes(subexons(genes))
    named = named_isoforms(placements(molecules(reads, settings), metas, settings, genome), settings)
    return named.select("sample", "qname", "cell", "label", "gene_id", "isoform", "score"), molecule_counts(named)


def genes_in_order(genes: DataFrame) -> DataFrame:
    """Genes numbered by place, the order of every later tie."""
    return genes.withColumn("ord", F.row_number().over(Window.orderBy("chrom", "start", "end", "gene_id")))
