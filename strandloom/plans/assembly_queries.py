"""Assembly operators over the test tables: an order's line items are a transfrag's exons, a customer a chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import double_text
from ..operators import assembly
from ..operators.components import connected_components
from .tables import SHIPMENTS_SQL, days, days_sql, read, shipments


def linked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders: those of one customer less than 60 days apart are linked."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", days("o_orderdate").alias("day"))
    other = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("day").alias("other"))
    edges = orders.join(other, "o_custkey").where("o_orderkey < b AND abs(day - other) < 60").select(F.col("o_orderkey").alias("a"), "b")
    return connected_components(edges)


_LINKED_SQL = f"""
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, {days_sql('o_orderdate')} AS d FROM orders),
    e AS (SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND abs(x.d - y.d) < 60),
    r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
    SELECT node, min(reached) AS component FROM r GROUP BY node"""


def _transfrags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items' stretches as exons; two fifths of them have a strand."""
    lines = shipments(spark, sf_dir).where("d < f").select("l_orderkey", "d", "f", "l_quantity")
    exons = F.array_sort(F.collect_list(F.struct(F.col("d").alias("start"), F.col("f").alias("end"))))
    joined = F.aggregate("all", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda out, e: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= e["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], e["end"]).alias("end"))))).otherwise(F.concat(out, F.array(e))))
    own = lines.groupBy("l_orderkey").agg(exons.alias("all"), F.sum("l_quantity").cast("double").alias("expr"))
    turn = F.col("l_orderkey") % 5
    strand = F.when(turn == 0, "+").when(turn == 1, "-").otherwise(".")
    customers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("chrom"))
    return own.join(customers, "l_orderkey").select(F.col("l_orderkey").alias("id"), "chrom", strand.alias("strand"), joined.alias("exons"), "expr", (F.col("l_orderkey") % 3).alias("sample_ord"), F.col("l_orderkey").alias("ord"), F.lit(False).alias("is_ref"))


def strand_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strand each order takes from those its stretches meet, and the round in which it does."""
    return assembly.impute_strands(_transfrags(spark, sf_dir), ["chrom"], width=64).select("id", "strand", F.coalesce("round", F.lit(-1)).alias("round"))


def _strands_sql(rounds: int = 12) -> str:
    """More rounds than the tables need: one without a change leaves all as it is."""
    steps = [
        f"x AS (SELECT o_custkey AS c, l_orderkey AS id, d, f FROM {SHIPMENTS_SQL} JOIN orders ON o_orderkey = l_orderkey WHERE d < f)",
        "t0 AS MATERIALIZED (SELECT DISTINCT id, CASE id % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand, CASE WHEN id % 5 < 2 THEN 0 END AS round FROM x)",
        "near AS MATERIALIZED (SELECT DISTINCT p.id AS a, q.id AS b FROM x p JOIN x q ON p.c = q.c AND p.d < q.f AND q.d < p.f WHERE p.id % 5 > 1 AND p.id <> q.id)",
    ]
    for k in range(1, rounds + 1):
        steps.append(f"h{k} AS (SELECT a, min(t.strand) AS strand FROM near JOIN t{k - 1} t ON t.id = b AND t.strand IS NOT NULL GROUP BY a HAVING min(t.strand) = max(t.strand))")
        steps.append(f"t{k} AS MATERIALIZED (SELECT id, coalesce(t.strand, h.strand) AS strand, CASE WHEN t.strand IS NULL AND h.strand IS NOT NULL THEN {k} ELSE round END AS round FROM t{k - 1} t LEFT JOIN h{k} h ON h.a = t.id)")
    return f"WITH {', '.join(steps)} SELECT id, coalesce(strand, '.') AS strand, coalesce(round, -1) AS round FROM t{rounds}"


def splice_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isoforms assembled from the orders of each customer, with their numbers."""
    found = assembly.assembled_isoforms(_transfrags(spark, sf_dir))
    return found.select("chrom", "strand", "locus", "gene", "tss", "transcript", F.to_json("exons").alias("exons"), F.round("flow", 3).alias("flow"), F.round("share", 5).alias("share"))


def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", double_text(F.col("l_extendedprice").cast("double") / 7).alias("price"))


_PRICE_SQL = "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DOUBLE) / 7 AS VARCHAR) AS price FROM lineitem"

QUERIES = {f.__name__: f for f in (linked_orders, strand_imputation, splice_assembly, price_text)}
ORACLE_SQL = {"linked_orders": _LINKED_SQL, "strand_imputation": _strands_sql(), "price_text": _PRICE_SQL}
