"""Parsing, rounding and naming expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, numbers, text
from .tables import read


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments made of a line item's numbers: clip, match, deletion, skip, insertion, match."""
    q = F.col("l_quantity").cast("long")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1).alias("pos"), q.alias("q"), (F.col("l_suppkey") % 9 + 1).alias("k"))
    made = F.format_string("%dS%dM%dD%dN%dI%d=%dX", "l_linenumber", "q", "k", F.col("q") + 10, F.lit(2), F.col("k") + 3, F.lit(1))
    return rows.withColumn("cigar", made)


def _exons(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """The alignments with their exons as a column, so that the fold runs once however often it is read."""
    return _cigars(spark, sf_dir).withColumn("exons", cigar.exons_of(F.col("pos") - shift, F.col("cigar")))


_CIGAR_SQL = "(SELECT l_orderkey, l_linenumber, l_partkey + 1 AS pos, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 9 + 1 AS k FROM lineitem)"


def cigar_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_of = lambda part: F.array_join(F.transform("exons", lambda e: e[part].cast("string")), ",")
    return _exons(spark, sf_dir).select("l_orderkey", "l_linenumber", "cigar", text_of("start").alias("starts"), text_of("end").alias("ends"))


def cigar_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = cigar.operations(F.col("cigar"))
    return _cigars(spark, sf_dir).select("l_orderkey", "l_linenumber", cigar.mapped_length(ops).alias("mapped"), cigar.query_length(ops).alias("query"), cigar.reference_span(ops).alias("span"), cigar.clipped(ops, "S").alias("soft"))


def cigar_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = cigar.introns(F.col("exons"))
    return _exons(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(F.transform(gaps, lambda g: F.concat_ws("-", g["start"].cast("string"), g["end"].cast("string"))), ",").alias("introns"))


def read_identity_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cigars(spark, sf_dir)
    length, none, two = F.col("q") + F.col("k") + 6 + F.col("l_linenumber"), F.lit(0), F.lit(2)
    soft, one, gap = F.col("l_linenumber"), F.lit(1), F.col("k")
    return rows.select("l_orderkey", "l_linenumber", cigar.coverage_percent(length, none, soft).alias("coverage"), cigar.identity_percent(length, none, soft, two, gap, one, over_read=True).alias("over_read"), cigar.identity_percent(length, none, soft, two, gap, one, over_read=False).alias("over_map"))


def bed_block_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("exons")
    sizes, starts = text.block_lists(found, F.col("pos") - 1)
    row = F.concat_ws("\t", F.lit("chr1"), (F.col("pos") - 1).cast("string"), F.element_at(found, -1)["end"].cast("string"), F.format_string("G%d;G%d.%d", "l_orderkey", "l_orderkey", "l_linenumber"), F.lit("40"), F.lit("+"), F.size(found).cast("string"), sizes, starts)
    return _exons(spark, sf_dir, 1).select("l_orderkey", "l_linenumber", row.alias("bed"))


def exon_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line numbers by the order of their exon lists, compared element by element."""
    from pyspark.sql import Window

    found = F.flatten(F.transform(cigar.exons_of(F.col("pos"), F.col("cigar")), lambda e: F.array(e["start"], e["end"])))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("exons", "l_linenumber"))
    return _cigars(spark, sf_dir).withColumn("exons", found).select("l_orderkey", "l_linenumber", rank.alias("place"))


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as sequences: vowels and other letters mapped to bases, the rest to N."""
    letters = F.regexp_replace("text", "[^a-z]", "")
    return read(spark, sf_dir, "documents").select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


_BASES_SQL = "(SELECT doc_id, translate(regexp_replace(text, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir).select("doc_id", F.md5(text.reverse_complement(F.col("seq")).cast("binary")).alias("digest"), F.length("seq").cast("long").alias("n"))


def homopolymer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir).select("doc_id", text.longest_run(F.col("seq"), "A").alias("a_run"), text.longest_run(F.col("seq"), "T").alias("t_run"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("q"))


def two_decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths, among them the exact ties."""
    return _prices(spark, sf_dir).select("l_orderkey", "l_linenumber", numbers.two_decimals((F.col("k") * 8 + F.col("q")) / 8.0 * F.when(F.col("q") % 2 == 0, -1).otherwise(1)).alias("v"))


def round_half_even2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir).select("l_orderkey", "l_linenumber", numbers.half_even_two((F.col("k") * 8 + F.col("q")) / 8.0).alias("v"))


def round_ten_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir).select("l_orderkey", "l_linenumber", numbers.ten_thousands(F.col("k") * 2500).alias("v"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_partkey") % 3 == 0, "_chr").when(F.col("p_partkey") % 3 == 1, "_NM_").otherwise("-"), F.col("p_partkey").cast("string"), F.lit(":x")).alias("name"))


_NAMES_SQL = "(SELECT p_partkey, translate(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_chr' WHEN 1 THEN '_NM_' ELSE '-' END || p_partkey || ':x' AS name FROM part)"


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcript, gene = text.split_name(F.col("name"))
    return _names(spark, sf_dir).select("p_partkey", transcript.alias("transcript"), gene.alias("gene"))


def strip_novel_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", text.without_novel_suffix(F.col("name")).alias("name"))


def gtf_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), F.col("p_name"), F.lit('";'))
    return read(spark, sf_dir, "part").select("p_partkey", text.attribute(line, "gene_id").alias("gene_id"), text.attribute(line, "gene_name").alias("gene_name"), text.attribute(line, "transcript_id").alias("transcript_id"))


QUERIES = {f.__name__: f for f in (cigar_exons, cigar_spans, cigar_introns, read_identity_percent, bed_block_format, exon_order_sort, reverse_complement, homopolymer_run, two_decimal_text, round_half_even2, round_ten_thousand, split_names, strip_novel_suffix, gtf_attribute)}
_KEYS = "l_orderkey, l_linenumber"
_EIGHTHS = "SELECT l_orderkey, l_linenumber, l_partkey * 8 + CAST(l_quantity AS BIGINT) AS e, CAST(l_quantity AS BIGINT) % 2 = 0 AS neg FROM lineitem"
ORACLE_SQL = {
    "cigar_exons": f"SELECT {_KEYS}, l_linenumber || 'S' || q || 'M' || k || 'D' || (q + 10) || 'N2I' || (k + 3) || '=1X' AS cigar, pos || ',' || (pos + q + k + q + 10) AS starts, (pos + q + k) || ',' || (pos + q + k + q + 10 + k + 4) AS ends FROM {_CIGAR_SQL}",
    "cigar_spans": f"SELECT {_KEYS}, q + k + k + 4 AS mapped, q + 2 + k + 4 AS query, q + k + q + 10 + k + 4 AS span, CAST(l_linenumber AS BIGINT) AS soft FROM {_CIGAR_SQL}",
    "cigar_introns": f"SELECT {_KEYS}, (pos + q + k) || '-' || (pos + q + k + q + 10) AS introns FROM {_CIGAR_SQL}",
    "read_identity_percent": f"WITH r AS (SELECT *, q + k + 6 + l_linenumber AS n FROM {_CIGAR_SQL}) SELECT {_KEYS}, CAST(n - l_linenumber AS DOUBLE) / n * 100.0::DOUBLE AS coverage, CAST(n - (2 + k + 1) - l_linenumber AS DOUBLE) / n * 100.0::DOUBLE AS over_read, CAST(n - l_linenumber - (2 + k + 1) AS DOUBLE) / (n - l_linenumber) * 100.0::DOUBLE AS over_map FROM r",
    "bed_block_format": f"SELECT {_KEYS}, concat_ws(chr(9), 'chr1', pos - 1, pos - 1 + q + k + q + 10 + k + 4, 'G' || l_orderkey || ';G' || l_orderkey || '.' || l_linenumber, '40', '+', '2', (q + k) || ',' || (k + 4), '0,' || (q + k + q + 10)) AS bed FROM {_CIGAR_SQL}",
    "exon_order_sort": f"SELECT {_KEYS}, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, pos + q + k, pos + q + k + q + 10, pos + q + k + q + 10 + k + 4, l_linenumber) AS INTEGER) AS place FROM {_CIGAR_SQL}",
    "reverse_complement": f"SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest, length(seq) AS n FROM {_BASES_SQL}",
    "homopolymer_run": f"SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+'), lambda x: length(x))), 0) AS a_run, coalesce(list_max(list_transform(regexp_extract_all(seq, 'T+'), lambda x: length(x))), 0) AS t_run FROM {_BASES_SQL}",
    "two_decimal_text": f"WITH r AS ({_EIGHTHS}) SELECT {_KEYS}, CASE WHEN neg THEN -1 ELSE 1 END * CAST(CASE WHEN e % 2 = 0 THEN e * 100 // 8 ELSE e * 100 // 8 + 1 END AS DOUBLE) / 100 AS v FROM r",
    "round_half_even2": f"WITH r AS ({_EIGHTHS}) SELECT {_KEYS}, CAST(e * 100 // 8 + CASE WHEN (e * 100) % 8 > 4 OR ((e * 100) % 8 = 4 AND (e * 100 // 8) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS v FROM r",
    "round_ten_thousand": f"WITH r AS (SELECT {_KEYS}, l_partkey * 2500 AS s FROM lineitem) SELECT {_KEYS}, CASE WHEN s % 10000 < 5000 OR (s % 10000 = 5000 AND (s // 10000) % 2 = 0) THEN s // 10000 ELSE s // 10000 + 1 END * 10000 AS v FROM r",
    "split_names": f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN regexp_extract(name, '^(.*)_chr', 1) WHEN p_partkey % 3 = 1 THEN regexp_extract(name, '^(.*)_NM', 1) WHEN contains(name, '_') THEN regexp_extract(name, '^(.*)_', 1) ELSE name END AS transcript, CASE WHEN p_partkey % 3 = 0 THEN 'chr' || p_partkey || ':x' WHEN p_partkey % 3 = 1 THEN 'NM_' || p_partkey || ':x' ELSE regexp_extract(name, '([^_]*)$', 1) END AS gene FROM {_NAMES_SQL}",
    "strip_novel_suffix": f"SELECT p_partkey, regexp_replace(name, '^(.*?)[_-][0-9]+', '\\1') AS name FROM {_NAMES_SQL}",
    "gtf_attribute": "SELECT p_partkey, 'G' || p_partkey AS gene_id, p_name AS gene_name, CAST(NULL AS VARCHAR) AS transcript_id FROM part",
}
