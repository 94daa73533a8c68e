"""Selection operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import selection
from .scalar_queries import _BASES_SQL, _bases
from .tables import read


def gene_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("gene_name"), F.col("n_nationkey").cast("string").alias("gene_id"), F.concat_ws("_", "n_name", "n_regionkey").alias("label"))
    name, label = genes.agg(F.min("gene_name"), F.max("label")).first()
    return selection.subset_genes(genes, [name, "7", label])


def novel_gathering(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    feature = F.when(k < 2, F.concat(F.col("event_type"), F.lit("-novel_"), k.cast("string"))).otherwise(F.concat_ws("-", "event_type", k.cast("string")))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), feature.alias("feature"))
    counts = rows.groupBy("cell", "feature").agg(F.count(F.lit(1)).alias("n"))
    return selection.gather_novel(counts, rows.select("feature", F.col("feature").alias("ord")).distinct())


def names_joined_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.translate("p_name", " ", ";"), F.lit(";x"))
    return read(spark, sf_dir, "part").select("p_partkey", text.joined_once(name).alias("name"))


def polya_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_quantity").cast("long") % 21
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("model"), F.lit("+").alias("strand"), a.alias("a_count"), (a / 16.0).alias("a_share"), F.lit("A").alias("polya_seq"))
    return selection.polya_report(rows).select("read", "model", "a_count", "a_percent")


def parts_per_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("v"))
    return selection.per_million(rows, "l_returnflag", "v").withColumn("v", F.round("v", 6))


def intron_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = _bases(spark, sf_dir).where(F.length("seq") >= 60).select(F.col("doc_id").cast("string").alias("chrom"), "seq", "doc_id")
    introns = bases.select("chrom", (F.col("doc_id") % 20).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("strand"))
    return selection.intron_motifs(introns, bases.select("chrom", "seq"), width=64)


QUERIES = {f.__name__: f for f in (gene_subset, novel_gathering, names_joined_once, polya_reads, parts_per_million, intron_motifs)}
ORACLE_SQL = {
    "gene_subset": "WITH g AS (SELECT n_name AS gene_name, CAST(n_nationkey AS VARCHAR) AS gene_id, n_name || '_' || n_regionkey AS label FROM nation) SELECT * FROM g WHERE gene_name = (SELECT min(gene_name) FROM g) OR gene_id = '7' OR label = (SELECT max(label) FROM g)",
    "novel_gathering": "WITH r AS (SELECT user_id AS cell, CASE WHEN event_id % 5 < 2 THEN (SELECT min(event_type) FROM events WHERE event_id % 5 < 2) || '-novel' ELSE event_type || '-' || (event_id % 5) END AS feature FROM events) SELECT cell, feature, count(*) AS n FROM r GROUP BY ALL",
    "names_joined_once": "SELECT p_partkey, regexp_replace(translate(p_name, ' ', ';') || ';x', ';', '_') AS name FROM part",
    "polya_reads": "WITH r AS (SELECT l_orderkey AS read, l_linenumber AS model, CAST(l_quantity AS BIGINT) % 21 AS a_count FROM lineitem), s AS (SELECT *, a_count * 10000 // 16 AS h, a_count * 10000 % 16 AS rest FROM r) SELECT read, model, a_count, CAST(h + CASE WHEN rest >= 8 THEN 1 ELSE 0 END AS DOUBLE) / 100 AS a_percent FROM s WHERE a_count * 100 > 70 * 16",
    "parts_per_million": "SELECT l_orderkey, l_linenumber, l_returnflag, round(1e6 * CAST(l_quantity AS DOUBLE) / sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_returnflag), 6) AS v FROM lineitem",
    "intron_motifs": f"WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, doc_id % 20 AS start, CAST(length(seq) AS BIGINT) AS \"end\", CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand, substr(seq, 1 + doc_id % 20, 2) || right(seq, 2) AS m FROM {_BASES_SQL} WHERE length(seq) >= 60) SELECT chrom, start, \"end\", strand, CASE strand WHEN '-' THEN reverse(translate(m, 'ACGT', 'TGCA')) ELSE m END AS motif FROM b",
}
