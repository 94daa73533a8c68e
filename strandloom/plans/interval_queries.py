"""Interval operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from .tables import SHIPMENTS_SQL, events, events_sql, shipments


def _clusters(spark: SparkSession, sf_dir: str, touching: bool) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "s", "e", "event_type", "value")
    return I.cluster_intervals(rows, ["user_id"], "s", "e", ["e", "event_id"], touching=touching)


def locus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_spans(_clusters(spark, sf_dir, True), ["user_id"], "s", "e")


def locus_clusters_touch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_spans(_clusters(spark, sf_dir, False), ["user_id"], "s", "e")


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (F.countDistinct("event_type").alias("n_types"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("event_id").alias("first_id"))
    return I.cluster_spans(_clusters(spark, sf_dir, True), ["user_id"], "s", "e", *more)


def _cluster_sql(compare: str, more: str = "") -> str:
    return f"""
    WITH a AS (SELECT user_id, event_id, s, e, event_type, value, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {events_sql()}),
    b AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR s {compare} reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster_id FROM a)
    SELECT user_id, cluster_id, min(s) AS start, max(e) AS "end", count(*) AS n{more} FROM b GROUP BY user_id, cluster_id"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features: the second quarter of every day on which a type occurs."""
    days = events(spark, sf_dir).select("event_type", F.floor(F.col("s") / 86400).alias("day")).distinct()
    return days.select("event_type", (F.col("day") * 86400 + 21600).alias("g_start"), (F.col("day") * 86400 + 43200).alias("g_end"))


_WINDOWS_SQL = f"(SELECT DISTINCT event_type, CAST(floor(s / 86400) AS BIGINT) * 86400 + 21600 AS g_start, CAST(floor(s / 86400) AS BIGINT) * 86400 + 43200 AS g_end FROM {events_sql()})"


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "event_id", "s", "e")
    return I.interval_join(rows, _windows(spark, sf_dir), ["event_type"], width=43200, left_span=("s", "e"), right_span=("g_start", "g_end"))


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "event_id", "s", "e")
    return I.interval_join(rows, _windows(spark, sf_dir), ["event_type"], width=43200, left_span=("s", "e"), right_span=("g_start", "g_end"), containment=True)


def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", F.col("s").alias("pos"))
    points = rows.where(F.col("event_type") != "purchase").drop("event_type")
    sites = rows.where(F.col("event_type") == "purchase").select("user_id", "pos")
    return I.nearest_site(points, sites, ["user_id"], "pos", point_order="event_id", window=86400)


_NEAREST_SQL = f"""
    WITH p AS (SELECT user_id, event_id, s AS pos FROM {events_sql()} WHERE event_type <> 'purchase'),
    q AS (SELECT DISTINCT user_id, s AS site FROM {events_sql()} WHERE event_type = 'purchase'),
    r AS (SELECT p.user_id, p.event_id, p.pos, q.site, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(q.site - p.pos), q.site) AS k
          FROM p LEFT JOIN q ON p.user_id = q.user_id AND abs(q.site - p.pos) <= 86400)
    SELECT user_id, event_id, pos, site FROM r WHERE k = 1"""


def subexon_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.disjoint_pieces(shipments(spark, sf_dir), ["l_orderkey"], "d", "f")


def base_coverage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.coverage_segments(shipments(spark, sf_dir), ["l_suppkey"], "d", "f")


def _sweep_sql(key: str, depth_filter: str) -> str:
    return f"""
    WITH c AS (SELECT {key}, d AS pos, 1 AS x FROM {SHIPMENTS_SQL} WHERE d < f UNION ALL SELECT {key}, f, -1 FROM {SHIPMENTS_SQL} WHERE d < f),
    s AS (SELECT {key}, pos, sum(x) AS x FROM c GROUP BY {key}, pos {depth_filter}),
    t AS (SELECT {key}, pos AS start, lead(pos) OVER (PARTITION BY {key} ORDER BY pos) AS "end", CAST(sum(x) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM s)"""


def run_length_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_lengths(events(spark, sf_dir), ["user_id"], ["s", "event_id"], "event_type")


_RUNS_SQL = f"""
    WITH a AS (SELECT user_id, s, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY s, event_id) = event_type THEN 0 ELSE 1 END AS x FROM {events_sql()}),
    b AS (SELECT *, CAST(sum(x) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM a)
    SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM b GROUP BY user_id, run"""


def junction_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed support of the gaps between an order's consecutive pieces."""
    from pyspark.sql import Window

    pieces = subexon_partition(spark, sf_dir)
    after = F.lead("start").over(Window.partitionBy("l_orderkey").orderBy("start"))
    gaps = pieces.withColumn("next", after).where(F.col("next") > F.col("end"))
    return gaps.groupBy(F.col("end").alias("start"), F.col("next").alias("end")).agg(F.count(F.lit(1)).alias("support"))


QUERIES = {f.__name__: f for f in (locus_clusters, locus_clusters_touch_split, cluster_members, interval_overlap_join, containment_join, nearest_site, subexon_partition, base_coverage_segments, run_length_encode, junction_support)}
_PIECES_SQL = _sweep_sql("l_orderkey", "")
ORACLE_SQL = {
    "locus_clusters": _cluster_sql(">"),
    "locus_clusters_touch_split": _cluster_sql(">="),
    "cluster_members": _cluster_sql(">", ", count(DISTINCT event_type) AS n_types, min(value) AS low, max(value) AS high, min(event_id) AS first_id"),
    "interval_overlap_join": f"SELECT a.event_type, a.event_id, a.s, a.e, g.g_start, g.g_end FROM {events_sql()} a JOIN {_WINDOWS_SQL} g ON a.event_type = g.event_type AND a.s < g.g_end AND g.g_start < a.e",
    "containment_join": f"SELECT a.event_type, a.event_id, a.s, a.e, g.g_start, g.g_end FROM {events_sql()} a JOIN {_WINDOWS_SQL} g ON a.event_type = g.event_type AND g.g_start <= a.s AND a.e <= g.g_end",
    "nearest_site": _NEAREST_SQL,
    "subexon_partition": _PIECES_SQL + ' SELECT l_orderkey, start, "end", CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY start) AS INTEGER) AS piece FROM t WHERE depth > 0 AND "end" IS NOT NULL',
    "base_coverage_segments": _sweep_sql("l_suppkey", "HAVING sum(x) <> 0") + ' SELECT l_suppkey, start, "end", depth FROM t WHERE depth <> 0 AND "end" IS NOT NULL',
    "run_length_encode": _RUNS_SQL,
    "junction_support": _PIECES_SQL + ', p AS (SELECT l_orderkey, start, "end", lead(start) OVER (PARTITION BY l_orderkey ORDER BY start) AS nxt FROM t WHERE depth > 0 AND "end" IS NOT NULL) SELECT "end" AS start, nxt AS "end", count(*) AS support FROM p WHERE nxt > "end" GROUP BY 1, 2',
}
