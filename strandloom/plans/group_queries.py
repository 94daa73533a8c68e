"""Grouping, ranking and testing operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import ordinals, ranks
from .tables import days, days_sql, events, events_sql, read

TYPES = ["click", "error", "purchase", "signup", "view"]


def keep_best_umi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return G.keep_best(rows, ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")])


def keep_best_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").alias("span"), "o_orderpriority", "o_orderkey")
    return G.keep_best(rows, ["o_custkey"], [F.desc("span"), F.asc("o_orderpriority"), F.asc("o_orderkey")])


def multimap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    passing = (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "O")
    return G.keep_best_passing(rows, ["o_custkey"], passing, "o_totalprice", "o_orderkey")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")


def coordinate_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vote(_quantities(spark, sf_dir), ["l_partkey"], "q", priority="l_returnflag")


def coordinate_vote_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vote(_quantities(spark, sf_dir), ["l_partkey"], "q", largest=True)


def _vote_sql(priority: str, tie: str) -> str:
    lead = f"{priority}, " if priority else ""
    return f"""WITH c AS (SELECT l_partkey, {lead}CAST(l_quantity AS BIGINT) AS q, count(*) AS votes FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {lead}votes DESC, {tie}) AS k FROM c) SELECT l_partkey, q, votes FROM r WHERE k = 1"""


def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_seen_mode(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


def wobble_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _quantities(spark, sf_dir).groupBy("l_partkey")
    return by.agg((F.max("q") - F.min("q")).alias("wobble"), F.max("q").alias("high"), F.min("q").alias("low"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", days("o_orderdate").alias("d"))


def end_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gap_groups(_dated(spark, sf_dir), ["o_custkey"], ["d", "o_orderkey"], [("d", 60)])


_GAPS_SQL = f"""WITH a AS (SELECT o_custkey, o_orderkey, {days_sql("o_orderdate")} AS d FROM orders),
    b AS (SELECT *, CASE WHEN d - coalesce(lag(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey), d) > 60 THEN 1 ELSE 0 END AS x FROM a)
    SELECT o_custkey, o_orderkey, d, CAST(sum(x) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS group_id FROM b"""


def chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_discount") * 100).cast("long").alias("usage"), F.col("l_quantity").cast("long").alias("n"), (F.col("l_quantity").cast("long") % 7).alias("len"))
    kept = G.keep_chains(rows, ["l_partkey"], usage="usage", count="n", order="ord", length="len", least_usage=8, least_count=600, rule="longest")
    return kept.where("keep").select("l_partkey", "ord", "max_usage", "sum_count", "last_group")


_CHAIN_SQL = """WITH r AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS ord, CAST(trunc(l_discount * 100) AS BIGINT) AS usage, CAST(l_quantity AS BIGINT) AS n, CAST(l_quantity AS BIGINT) % 7 AS len FROM lineitem),
    t AS (SELECT l_partkey, max(usage) AS max_usage, CAST(sum(n) AS BIGINT) AS sum_count, max(CASE WHEN len > 0 THEN ord END) AS last_group FROM r GROUP BY l_partkey)
    SELECT r.l_partkey, r.ord, max_usage, sum_count, last_group FROM r JOIN t USING (l_partkey) WHERE max_usage > 8 AND r.ord = last_group"""


def usage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return G.usage_with_other(rows, "l_partkey", "l_suppkey", "q", 0.05)


_USAGE_SQL = """WITH a AS (SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
    b AS (SELECT l_partkey, n, CASE WHEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_partkey) >= 0.05 THEN CAST(l_suppkey AS VARCHAR) ELSE 'other' END AS feature FROM a)
    SELECT l_partkey, feature, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL"""


def support_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.support_matrix(read(spark, sf_dir, "events"), "user_id", "event_type", TYPES)


def isoform_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ordered_ids(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey", "members")


def variant_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 5).cast("long").alias("bucket"), "user_id")
    return rows.groupBy("event_type", "bucket").agg(F.countDistinct("user_id").alias("support")).where("support >= 5")


def coverage_set_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("member"))
    return G.shared_member_groups(rows, "l_orderkey", "member").select("members", "n_keys", F.substring_index("keys", ",", 1).cast("long").alias("first_key"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_ranks(read(spark, sf_dir, "lineitem"), "l_quantity")


def tie_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.tie_correction(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"])


def wilcoxon_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranks.rank_sum_z(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "A", "R", "l_quantity")
    return found.select("l_suppkey", "u", F.round("z", 9).alias("z"))


_WILCOXON_SQL = """WITH b AS (SELECT l_suppkey, l_returnflag AS g, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY v) + (count(*) OVER (PARTITION BY l_suppkey, v) - 1) / 2.0 AS rk FROM b),
    t AS (SELECT l_suppkey, sum(CAST(k AS DOUBLE) * k * k - k) AS ties FROM (SELECT l_suppkey, v, count(*) AS k FROM b GROUP BY ALL) GROUP BY 1),
    s AS (SELECT l_suppkey, CAST(sum(CASE WHEN g = 'A' THEN rk END) AS DOUBLE) AS w, CAST(count(*) FILTER (g = 'A') AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1),
    x AS (SELECT l_suppkey, w - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, n, ties FROM s JOIN t USING (l_suppkey) WHERE n1 > 0),
    y AS (SELECT *, u - n1 * n2 / 2 AS shift, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS spread FROM x)
    SELECT l_suppkey, u, round(CASE WHEN n2 > 0 THEN CASE WHEN spread > 0 THEN (shift - sign(shift) * 0.5) / spread ELSE 0.0 END END, 9) AS z FROM y"""


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p value for each customer, with ties."""
    rows = read(spark, sf_dir, "customer")
    return rows.select("c_custkey", ((F.pmod(F.col("c_custkey") * 7919, F.lit(997)) + 1) / F.lit(200000.0)).alias("p"))


_P_SQL = "(SELECT c_custkey, ((c_custkey * 7919) % 997 + 1) / 200000.0::DOUBLE AS p FROM customer)"


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.holm(_p_values(spark, sf_dir), "p", "c_custkey").select("c_custkey", F.round("adjusted", 12).alias("adjusted"))


def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.benjamini_hochberg(_p_values(spark, sf_dir), "p", "c_custkey").select("c_custkey", F.round("adjusted", 12).alias("adjusted"))


def _gappy_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh customer without a p value, most of the others with 1."""
    p = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 0, F.col("p")).otherwise(F.lit(1.0))
    return _p_values(spark, sf_dir).withColumn("p", p)


_GAPPY_SQL = f"(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN p ELSE 1.0::DOUBLE END AS p FROM {_P_SQL})"


def holm_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.holm(_gappy_p_values(spark, sf_dir), "p").select("c_custkey", F.round("adjusted", 12).alias("adjusted"))


def bh_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.benjamini_hochberg(_gappy_p_values(spark, sf_dir), "p").select("c_custkey", F.round("adjusted", 12).alias("adjusted"))


def fraction_logfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    by = rows.groupBy("c_mktsegment").agg(F.avg((F.col("c_acctbal") > 0).cast("double")).alias("fraction"), F.sum(F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0)).cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    return by.select("c_mktsegment", F.round("fraction", 9).alias("fraction"), F.round(F.log(2.0, (F.col("a") + 0.01) / (F.col("n") - F.col("a") + 0.01)), 9).alias("log_ratio"))


def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return G.top_k(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 3)


def dense_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals.global_dense_rank(events(spark, sf_dir).select("event_id", "s"), "s").select("event_id", "ordinal")


def global_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals.global_row_number(events(spark, sf_dir).select("event_id", "s"), "s", ["event_id"]).select("event_id", "ordinal")


def sample_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression per million of the sample's total, with the counts of what each filter drops."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("double").alias("x"))
    share = rows.withColumn("per_million", F.lit(1e6) * F.col("x") / F.sum("x").over(Window.partitionBy("o_orderstatus")))
    return share.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("per_million") < 50).cast("long")).alias("low"), F.sum((F.col("x") < 1000).cast("long")).alias("short"))


QUERIES = {f.__name__: f for f in (keep_best_umi, keep_best_dedup, multimap_best, coordinate_vote, coordinate_vote_end, mode_first_seen, wobble_range, end_groups, chain_filter, usage_fraction, support_pivot, isoform_map, variant_support, coverage_set_groups, average_ranks, tie_correction, wilcoxon_rank_sum, holm_adjust, bh_adjust, holm_nulls, bh_ties, fraction_logfc, top_k_per_group, dense_ordinals, global_row_numbers, sample_normalise)}
ORACLE_SQL = {
    "keep_best_umi": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1",
    "keep_best_dedup": "SELECT o_custkey, span, o_orderpriority, o_orderkey FROM (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS span, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1",
    "multimap_best": "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 150000 AND o_orderstatus = 'O' THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k = 1",
    "coordinate_vote": _vote_sql("l_returnflag", "q"),
    "coordinate_vote_end": _vote_sql("", "q DESC"),
    "mode_first_seen": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS k FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL)) WHERE k = 1",
    "wobble_range": "SELECT l_partkey, CAST(max(l_quantity) AS BIGINT) - CAST(min(l_quantity) AS BIGINT) AS wobble, CAST(max(l_quantity) AS BIGINT) AS high, CAST(min(l_quantity) AS BIGINT) AS low FROM lineitem GROUP BY 1",
    "end_groups": _GAPS_SQL,
    "chain_filter": _CHAIN_SQL,
    "usage_fraction": _USAGE_SQL,
    "support_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1",
    "isoform_map": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1",
    "variant_support": "SELECT event_type, CAST(floor(value / 5) AS BIGINT) AS bucket, count(DISTINCT user_id) AS support FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 5",
    "coverage_set_groups": "SELECT members, count(*) AS n_keys, CAST(min(l_orderkey) AS BIGINT) AS first_key FROM (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey % 5 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 5 AS VARCHAR)) AS members FROM lineitem GROUP BY 1) GROUP BY 1",
    "average_ranks": "SELECT DISTINCT l_quantity, count(*) OVER (PARTITION BY l_quantity) AS n, CAST(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM lineitem",
    "tie_correction": "SELECT l_suppkey, CASE WHEN sum(t) > 1 THEN 1.0::DOUBLE - sum(t * t * t - t) / (sum(t) * sum(t) * sum(t) - sum(t)) ELSE 1.0::DOUBLE END AS correction FROM (SELECT l_suppkey, l_quantity, CAST(count(*) AS DOUBLE) AS t FROM lineitem GROUP BY ALL) GROUP BY 1",
    "wilcoxon_rank_sum": _WILCOXON_SQL,
    "holm_adjust": f"WITH r AS (SELECT c_custkey, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, c_custkey) + 1)) AS x, row_number() OVER (ORDER BY p, c_custkey) AS k FROM {_P_SQL}) SELECT c_custkey, round(max(x) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 12) AS adjusted FROM r",
    "bh_adjust": f"WITH r AS (SELECT c_custkey, least(1.0::DOUBLE, p * count(*) OVER () / row_number() OVER (ORDER BY p, c_custkey)) AS x, row_number() OVER (ORDER BY p, c_custkey) AS k FROM {_P_SQL}) SELECT c_custkey, round(min(x) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 12) AS adjusted FROM r",
    "holm_nulls": f"WITH g AS (SELECT * FROM {_GAPPY_SQL}), r AS (SELECT c_custkey, p, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS n FROM g WHERE p IS NOT NULL), a AS (SELECT c_custkey, max(least(1.0::DOUBLE, p * (n - k + 1))) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM r) SELECT g.c_custkey, round(x, 12) AS adjusted FROM g LEFT JOIN a USING (c_custkey)",
    "bh_ties": f"WITH g AS (SELECT * FROM {_GAPPY_SQL}), r AS (SELECT c_custkey, p, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS n FROM g WHERE p IS NOT NULL), a AS (SELECT c_custkey, min(least(1.0::DOUBLE, p * n / k)) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM r) SELECT g.c_custkey, round(x, 12) AS adjusted FROM g LEFT JOIN a USING (c_custkey)",
    "fraction_logfc": "SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS fraction, round(log2((count(*) FILTER (c_custkey % 2 = 0) + 0.01::DOUBLE) / (count(*) FILTER (c_custkey % 2 <> 0) + 0.01::DOUBLE)), 9) AS log_ratio FROM customer GROUP BY 1",
    "top_k_per_group": "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3",
    "dense_ordinals": f"SELECT event_id, dense_rank() OVER (ORDER BY s) AS ordinal FROM {events_sql()}",
    "global_row_numbers": f"SELECT event_id, row_number() OVER (ORDER BY s, event_id) AS ordinal FROM {events_sql()}",
    "sample_normalise": "WITH r AS (SELECT o_orderstatus, CAST(floor(o_totalprice) AS DOUBLE) AS x FROM orders), s AS (SELECT *, 1e6::DOUBLE * x / sum(x) OVER (PARTITION BY o_orderstatus) AS pm FROM r) SELECT o_orderstatus, count(*) AS n, count(*) FILTER (pm < 50) AS low, count(*) FILTER (x < 1000) AS short FROM s GROUP BY 1",
}
