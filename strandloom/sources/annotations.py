"""FASTA, BED12, GTF, manifests and count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import attribute
from .lines import columns, numbered_lines, whole_number


def _error(message: str) -> Column:
    return F.raise_error(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(f": {message}")))


def read_fasta(spark: SparkSession, *paths: str, unique: bool = False) -> DataFrame:
    """(path, id, description, seq) of FASTA files: the id is the first token, sequences upper-case and trimmed.

    An empty header, and sequence before any header, are errors. Repeated ids: an error where
    ``unique``, else the last one counts.
    """
    by = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = numbered_lines(spark, *paths).withColumn("text", F.trim("text")).where("text <> ''")
    head = F.col("text").startswith(">")
    marked = lines.withColumn("record", F.sum(head.cast("int")).over(by)).withColumn("text", F.when(F.col("record") == 0, _error("sequence before a header")).when(head & (F.trim(F.substring("text", 2, 1 << 30)) == ""), _error("empty header")).otherwise(F.col("text")))
    pieces = F.array_sort(F.collect_list(F.when(~head, F.struct("line", "text"))))
    records = marked.groupBy("path", "record").agg(F.min("line").alias("line"), F.max(F.when(head, F.substring("text", 2, 1 << 30))).alias("header"), F.upper(F.array_join(F.transform(pieces, lambda p: p["text"]), "")).alias("seq"))
    header = F.trim("header")
    out = records.select("path", "line", F.regexp_extract(header, r"^(\S+)", 1).alias("id"), F.trim(F.regexp_replace(header, r"^\S+", "")).alias("description"), "seq")
    same = Window.partitionBy("id")
    if unique:
        n = F.count(F.lit(1)).over(same)
        return out.withColumn("id", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated sequence id "), F.col("id")))).otherwise(F.col("id")))
    return out.withColumn("_last", F.row_number().over(same.orderBy(F.desc("path"), F.desc("line")))).where("_last = 1").drop("_last")


def read_fasta_last_line(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, seq) where each sequence line replaces the one before, and ``_PAR_Y`` goes from ids that have a sequence."""
    by = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = numbered_lines(spark, *paths)
    head = F.col("text").startswith(">")
    marked = lines.withColumn("record", F.sum(head.cast("int")).over(by)).where("record > 0")
    records = marked.groupBy("path", "record").agg(F.max(F.when(head, F.substring("text", 2, 1 << 30))).alias("id"), F.max_by(F.when(~head, F.col("text")), F.when(~head, F.col("line"))).alias("seq"))
    return records.select("path", "record", F.when(F.col("seq").isNotNull(), F.replace("id", F.lit("_PAR_Y"), F.lit(""))).otherwise(F.col("id")).alias("id"), F.coalesce("seq", F.lit("")).alias("seq"))


def _numbers(text: Column, *, lenient: bool) -> Column:
    parts = F.filter(F.split(text, ","), lambda p: F.trim(p) != "")
    if lenient:
        return F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("bigint")), lambda n: n.isNotNull())
    return F.transform(parts, lambda p: F.trim(p).cast("bigint"))


def read_bed12(spark: SparkSession, *paths: str, flavour: str = "merge") -> DataFrame:
    """BED12 rows with their exons, 0-based half-open.

    ``merge``: exactly 12 columns, strand + or -, names ``gene;transcript``, block counts must agree.
    ``combine``: 12 columns or more, blank rows skipped, trailing space cut.
    ``precise``: 12 or more, ``#`` lines skipped, pieces of lists that are no numbers dropped.
    """
    lines = numbered_lines(spark, *paths)
    if flavour == "combine":
        lines = lines.withColumn("text", F.rtrim("text")).where("text <> ''")
    if flavour == "precise":
        lines = lines.where((F.trim("text") != "") & ~F.col("text").startswith("#"))
    rows = columns(lines, at_least=12, what="a BED12 row", exactly=flavour == "merge")
    f = F.col("f")
    lenient = flavour == "precise"
    rows = rows.select("path", "line", f[0].alias("chrom"), whole_number(f[1], "start").alias("start"), whole_number(f[2], "end").alias("end"), f[3].alias("name"), f[4].alias("score"), f[5].alias("strand"), whole_number(f[6], "thick start").alias("thick_start"), whole_number(f[7], "thick end").alias("thick_end"), f[8].alias("rgb"), whole_number(f[9], "block count").alias("n_blocks"), _numbers(f[10], lenient=lenient).alias("sizes"), _numbers(f[11], lenient=lenient).alias("starts"))
    rows = rows.withColumn("exons", F.zip_with("starts", "sizes", lambda s, n: F.struct((F.col("start") + s).alias("start"), (F.col("start") + s + n).alias("end"))))
    if flavour == "merge":
        bad_name = ~F.col("name").contains(";")
        uneven = (F.size("sizes") != F.col("n_blocks")) | (F.size("starts") != F.col("n_blocks"))
        rows = rows.withColumn("strand", F.when(~F.col("strand").isin("+", "-"), _error("strand must be + or -")).when(uneven, _error("block lists and block count differ")).when(bad_name, _error("name must be gene;transcript")).otherwise(F.col("strand")))
    return rows


def gtf_lines(spark: SparkSession, *paths: str) -> DataFrame:
    lines = numbered_lines(spark, *paths).where((F.trim("text") != "") & ~F.col("text").startswith("#"))
    rows = columns(lines, at_least=9, what="a GTF row")
    f = F.col("f")
    return rows.select("path", "line", f[0].alias("chrom"), f[2].alias("feature"), (whole_number(f[3], "start") - 1).alias("start"), whole_number(f[4], "end").alias("end"), f[6].alias("strand"), f[8].alias("attributes"))


def read_gtf_transfrags(spark: SparkSession, path: str, sample: str, *, expression: str | None = "FPKM") -> DataFrame:
    """Assembled transcripts of a sample: id ``sample.n``, exons in order, expression (none for a reference).

    A transcript row must come before its exons; a second row of one transcript, a missing
    expression and exons without a transcript are errors.
    """
    rows = gtf_lines(spark, path).where(F.col("feature").isin("transcript", "exon")).withColumn("tid", attribute(F.col("attributes"), "transcript_id"))
    is_t = F.col("feature") == "transcript"
    exons = F.array_sort(F.collect_list(F.when(~is_t, F.struct("start", "end"))))
    agg = rows.groupBy("tid").agg(F.min("path").alias("path"), F.min("line").alias("line"), F.sum(is_t.cast("int")).alias("n"), F.min(F.when(is_t, F.col("line"))).alias("t_line"), F.min(F.when(~is_t, F.col("line"))).alias("e_line"), F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.max(F.when(is_t, attribute(F.col("attributes"), expression or "FPKM"))).alias("expr"), exons.alias("exons"))
    problem = F.when(F.col("n") > 1, _error("repeated transcript")).when((F.col("n") == 0) | (F.col("e_line") < F.col("t_line")), _error("exon before its transcript"))
    if expression:
        problem = problem.when(F.col("expr").isNull(), _error("transcript without expression"))
    checked = agg.withColumn("chrom", F.when(F.col("n") != 1, problem).when(F.col("e_line") < F.col("t_line"), problem).when(F.lit(bool(expression)) & F.col("expr").isNull(), problem).otherwise(F.col("chrom")))
    number = F.row_number().over(Window.orderBy("t_line"))
    return checked.select(F.concat(F.lit(f"{sample}."), number.cast("string")).alias("id"), "chrom", "strand", "exons", F.col("expr").cast("double").alias("expr"), F.lit(not expression).alias("is_ref"), number.cast("long").alias("ord"))


def read_gtf_annotation(spark: SparkSession, *paths: str) -> DataFrame:
    """Genes with their isoforms: gene_id, gene_name, chrom, strand, start, end, isoforms (name, exons).

    The span is the gene row's, or the hull of the exons; genes without exons go; a gene on two
    chromosomes is an error. Genes come in order of place as ``ord``.
    """
    rows = gtf_lines(spark, *paths).where(F.col("feature").isin("gene", "transcript", "exon"))
    a = F.col("attributes")
    rows = rows.withColumn("gene_id", attribute(a, "gene_id")).where("gene_id IS NOT NULL").withColumn("gene_name", F.coalesce(attribute(a, "gene_name"), "gene_id")).withColumn("tid", attribute(a, "transcript_id")).withColumn("tname", F.coalesce(attribute(a, "transcript_name"), "tid"))
    per_t = rows.where("feature = 'exon' AND tid IS NOT NULL").groupBy("gene_id", "tid").agg(F.min("tname").alias("name"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"), F.min("line").alias("ord"))
    isoforms = per_t.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "tid", "exons"))).alias("isoforms"))
    is_gene = F.col("feature") == "gene"
    hull = rows.groupBy("gene_id").agg(F.countDistinct("chrom").alias("n_chrom"), F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.min_by("gene_name", "line").alias("gene_name"), F.coalesce(F.min(F.when(is_gene, F.col("start"))), F.min(F.when(F.col("feature") == "exon", F.col("start")))).alias("start"), F.coalesce(F.max(F.when(is_gene, F.col("end"))), F.max(F.when(F.col("feature") == "exon", F.col("end")))).alias("end"))
    checked = hull.withColumn("chrom", F.when(F.col("n_chrom") > 1, F.raise_error(F.concat(F.lit("gene on two chromosomes: "), F.col("gene_id")))).otherwise(F.col("chrom"))).drop("n_chrom")
    twice = F.count(F.lit(1)).over(Window.partitionBy("gene_name"))
    labelled = checked.join(isoforms, "gene_id").withColumn("label", F.when(twice > 1, F.concat_ws("_", "gene_name", "gene_id")).otherwise(F.col("gene_name")))
    return labelled.withColumn("ord", F.row_number().over(Window.orderBy("chrom", "start", "end", "gene_id")))


def read_gtf_ends(spark: SparkSession, *paths: str) -> DataFrame:
    """Annotated transcript starts (start - 1 of the file) and ends, by chromosome: (chrom, kind, pos)."""
    rows = gtf_lines(spark, *paths).where("feature = 'transcript'")
    return rows.select("chrom", F.explode(F.array(F.struct(F.lit("tss").alias("kind"), F.col("start").alias("pos")), F.struct(F.lit("tes").alias("kind"), F.col("end").alias("pos")))).alias("e")).select("chrom", "e.kind", "e.pos").distinct()


def read_merge_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path, capped, priority, name): exactly four columns; spaces, blank rows and other caps are errors."""
    rows = columns(numbered_lines(spark, path), at_least=4, what="a manifest row", exactly=True)
    f = F.col("f")
    odd = F.col("text").rlike("[ \r]") | ~f[1].isin("capped", "no_cap") | ~f[2].rlike(r"^\d+,\d+,\d+$")
    return rows.withColumn("ok", F.when(odd, _error("bad manifest row")).otherwise(F.lit(True))).where("ok").select(F.col("line").alias("ord"), f[0].alias("path"), (f[1] == "capped").alias("capped"), F.transform(F.split(f[2], ","), lambda p: p.cast("int")).alias("priority"), f[3].alias("name"))


def read_combine_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ord, sample, kind, bed, fasta, read_map): three to five columns; FASTA counts only if every row has one."""
    rows = columns(numbered_lines(spark, path).where("text <> ''"), at_least=3, what="a manifest row")
    f = F.col("f")
    optional = lambda k: F.when((F.size("f") > k) & (f[k] != ""), f[k])
    out = rows.select(F.col("line").alias("ord"), f[0].alias("sample"), f[1].alias("kind"), f[2].alias("bed"), F.when(F.size("f") > 3, optional(3)).alias("fasta"), F.when(F.size("f") > 4, optional(4)).alias("read_map"))
    every = F.min(F.col("fasta").isNotNull().cast("int")).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("fasta", F.when(every == 1, F.col("fasta")))


def read_sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path, sample): ids are given or counted over the unnamed rows; repeated paths or ids are errors."""
    rows = numbered_lines(spark, path).where("trim(text) <> ''").withColumn("f", F.split("text", "\t"))
    named = F.when((F.size("f") > 1) & (F.get("f", F.lit(1)) != ""), F.get("f", F.lit(1)))
    rows = rows.select("path", "line", F.trim(F.col("f")[0]).alias("file"), named.alias("given"))
    auto = F.row_number().over(Window.partitionBy(F.col("given").isNull()).orderBy("line")).cast("string")
    rows = rows.withColumn("sample", F.coalesce("given", auto))
    twice = (F.count(F.lit(1)).over(Window.partitionBy("file")) > 1) | (F.count(F.lit(1)).over(Window.partitionBy("sample")) > 1)
    return rows.select(F.col("line").alias("ord"), F.when(twice, _error("repeated path or id")).otherwise(F.col("file")).alias("path"), "sample")


def read_read_map(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Reads by isoform (its last row counts) and by gene (all rows add up; the gene is the name's last ``_`` token)."""
    rows = columns(numbered_lines(spark, *paths).where("text <> ''"), at_least=2, what="a read map row").select("path", "line", F.col("f")[0].alias("isoform"), F.size(F.split(F.col("f")[1], ",")).cast("long").alias("n"))
    return rows.groupBy("isoform").agg(F.max_by("n", "line").alias("n")), rows.groupBy(F.substring_index("isoform", "_", -1).alias("gene")).agg(F.sum("n").alias("n"))


def read_count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A cells x features CSV in long form (cell, feature, n), zeros left out."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    cell, *features = wide.columns
    long = wide.unpivot(cell, features, "feature", "n") if features else wide.select(cell, F.lit(None).alias("feature"), F.lit(None).alias("n"))
    number = F.col("n").try_cast("double")
    checked = F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a number in column "), F.col("feature"), F.lit(": "), F.coalesce("n", F.lit(""))))).otherwise(number)
    return long.select(F.col(cell).alias("cell"), "feature", checked.alias("n")).where("n <> 0")


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """(gene, feature, ord) from a table with the columns ``genes`` and ``transcripts`` at any place."""
    rows = numbered_lines(spark, path)
    first = F.split(F.first(F.when(F.col("line") == 1, F.col("text")), True).over(Window.partitionBy("path")), "\t")
    f = F.split("text", "\t", -1)
    at = lambda name: F.get(f, F.array_position(first, name).cast("int") - 1)
    return rows.select(at("genes").alias("gene"), at("transcripts").alias("feature"), "line").where("line > 1").withColumnRenamed("line", "ord")


def read_long_counts(spark: SparkSession, path: str) -> DataFrame:
    """(cell, feature, n) from barcode/transcript/count or feature/group/count tables; ``#`` lines and zeros go."""
    rows = numbered_lines(spark, path).where(~F.col("text").startswith("#") & (F.trim("text") != ""))
    by = Window.partitionBy("path")
    head = F.split(F.first("text").over(by.orderBy("line")), "\t")
    rows = columns(rows.withColumn("head", head).withColumn("top", F.min("line").over(by)), at_least=3, what="a count row").where("line > top")
    f = F.col("f")
    barcode_first = F.col("head")[0] == "barcode"
    return rows.select(F.when(barcode_first, f[0]).otherwise(f[1]).alias("cell"), F.when(barcode_first, f[1]).otherwise(f[0]).alias("feature"), f[2].cast("double").alias("n")).where("n <> 0")
