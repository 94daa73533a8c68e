"""Differential expression and isoform usage between two groups of cells.

Counts are long frames (cell, feature, n) without zeros; zero-filling is arithmetic, never a cross
join. Gene tests are aggregates over distinct counts; isoform tests are one Arrow-fed kernel a
gene, which holds that gene's non-zero counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.dirichlet import UsageSettings, usage_test
from ..kernels.special import normal_two_sided
from . import ranks

_ROW = "gene string, isoform string, alpha1 double, alpha2 double, TU1 double, TU2 double, TU_diff double, TU_var1 double, TU_var2 double, dispersion1 double, dispersion2 double, isoform_switch boolean, isoform_switch_ES double, p_DTU_gene double, p_transcript double"


def with_zeros(counts: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, value, n): how many cells hold each count of each key, the cells without any included."""
    by = counts.groupBy(*keys, F.col("n").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    zeros = by.groupBy(*keys).agg((F.lit(cells) - F.sum("n")).alias("n")).where("n > 0").withColumn("value", F.lit(0.0))
    return by.unionByName(zeros)


def gene_tests(a: DataFrame, b: DataFrame, cells: tuple[int, int], settings: UsageSettings = UsageSettings()) -> DataFrame:
    """Rank-sum tests of the genes both groups have: pct1, pct2, logFC, p_gene, pct_diff, p_gene_adj (Holm)."""
    sides = [with_zeros(x.withColumnRenamed("feature", "gene"), ["gene"], n).withColumn("side", F.lit(k)) for k, (x, n) in enumerate(zip((a, b), cells, strict=True))]
    both = sides[0].unionByName(sides[1])
    sums = both.groupBy("gene").agg(
        F.countDistinct("side").alias("sides"),
        *(F.sum(F.when((F.col("side") == k) & (F.col("value") > 0), F.col("n")).otherwise(0)).alias(f"above{k}") for k in (0, 1)),
        *(F.sum(F.when(F.col("side") == k, F.col("value") * F.col("n")).otherwise(0.0)).alias(f"sum{k}") for k in (0, 1)),
    ).where("sides = 2")
    z = ranks.rank_sum_z_of_counts(both, ["gene"], "side", 0, "value", "n").select("gene", "z")

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(z.fillna(0.0).to_numpy()))

    mean = [F.col(f"sum{k}") / n + settings.epsilon for k, n in enumerate(cells)]
    tested = sums.join(z, "gene").select(
        "gene",
        (F.col("above0") / cells[0]).alias("pct1"),
        (F.col("above1") / cells[1]).alias("pct2"),
        F.when((mean[0] > 0) & (mean[1] > 0), F.log(2.0, mean[0] / mean[1])).otherwise(F.lit(float("nan"))).alias("logFC"),
        two_sided("z").alias("p_gene"),
    ).persist()
    return ranks.holm(tested.withColumn("pct_diff", F.col("pct1") - F.col("pct2")), "p_gene", "gene", out="p_gene_adj")


def isoform_tests(a: DataFrame, b: DataFrame, map_a: DataFrame, map_b: DataFrame, cells: tuple[int, int], settings: UsageSettings = UsageSettings()) -> DataFrame:
    """Dirichlet-multinomial tests of each gene's isoforms, Benjamini-Hochberg over genes and over isoforms.

    ``map_a``, ``map_b``: (gene, feature, ord), ord giving the order of a gene's isoforms.
    """
    sides = [x.join(m, "feature", "right").withColumn("side", F.lit(k)) for k, (x, m) in enumerate(((a, map_a), (b, map_b)))]
    rows = sides[0].unionByName(sides[1]).select("gene", "side", "ord", "feature", "cell", F.col("n").cast("double").alias("n"))

    def test(gene: pd.DataFrame) -> pd.DataFrame:
        names, counts = [], []
        for side in (0, 1):
            own = gene[gene.side == side].sort_values(["ord", "feature"])
            features = list(dict.fromkeys(own.feature))
            full = own[own.cell.notna()]
            cell = pd.factorize(full.cell)[0]
            x = np.zeros((cell.max() + 1 if len(cell) else 0, len(features)))
            np.add.at(x, (cell, full.feature.map({f: i for i, f in enumerate(features)}).to_numpy(dtype=int)), full.n.to_numpy())
            names.append(features)
            counts.append(x)
        found = usage_test(tuple(names), tuple(counts), cells, settings)
        columns = [c.split()[0] for c in _ROW.split(", ")]
        return pd.DataFrame([{"gene": gene.gene.iloc[0], **r} for r in found or []], columns=columns)

    tested = rows.groupBy("gene").applyInPandas(test, _ROW).persist()  # fits are read several times below
    genes = ranks.benjamini_hochberg(tested.select("gene", "p_DTU_gene").distinct(), "p_DTU_gene", "gene", out="p_DTU_gene_adj").select("gene", "p_DTU_gene_adj")
    return ranks.benjamini_hochberg(tested.withColumn("_key", F.struct("gene", "isoform")), "p_transcript", "_key", out="p_transcript_adj").drop("_key").join(genes, "gene")


def differential_usage(genes_a: DataFrame, isoforms_a: DataFrame, map_a: DataFrame, genes_b: DataFrame, isoforms_b: DataFrame, map_b: DataFrame, settings: UsageSettings = UsageSettings()) -> DataFrame:
    """One row for each tested isoform, one without isoform for each gene that only the rank test covers."""
    gene_cells = tuple(x.select("cell").distinct().count() for x in (genes_a, genes_b))
    cells = tuple(x.select("cell").distinct().count() for x in (isoforms_a, isoforms_b))
    genes = gene_tests(genes_a, genes_b, gene_cells, settings)
    return genes.join(isoform_tests(isoforms_a, isoforms_b, map_a, map_b, cells, settings), "gene", "full")
