"""Scans along few long keys over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import scans
from ..operators.intervals import cluster_spans
from .tables import SHIPMENTS_SQL, events, events_sql, shipments

_KEYS, _WIDTH = ["event_type"], 20_000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ten minutes and more, so that clusters end."""
    rows = events(spark, sf_dir, 600).selectExpr("event_type", "event_id", "s", "s + 60 + event_id % 600 AS e")
    return rows


_ROWS = f"(SELECT event_type, event_id, s, s + 60 + event_id % 600 AS e FROM {events_sql()})"


def type_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_spans(scans.cluster_by_bins(_rows(spark, sf_dir), _KEYS, "s", "e", ["e", "event_id"], width=_WIDTH), _KEYS, "s", "e")


def type_clusters_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_spans(scans.cluster_by_bins(_rows(spark, sf_dir), _KEYS, "s", "e", ["e", "event_id"], width=_WIDTH, gap=-1), _KEYS, "s", "e")


def type_clusters_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_spans(scans.cluster_by_bins(_rows(spark, sf_dir), _KEYS, "s", "e", ["e", "event_id"], width=_WIDTH, gap=300), _KEYS, "s", "e")


def type_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_spans(scans.chain_by_bins(_rows(spark, sf_dir), _KEYS, "s", "e", ["e", "event_id"], width=_WIDTH, window=400), _KEYS, "s", "e")


def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.coverage_by_bins(_rows(spark, sf_dir), _KEYS, "s", "e", width=_WIDTH)


def flag_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.pieces_by_bins(shipments(spark, sf_dir), ["l_returnflag"], "d", "f", width=100)


def _spans_sql(new: str) -> str:
    order = "PARTITION BY event_type ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
    WITH a AS (SELECT *, max(e) OVER ({order} 1 PRECEDING) AS reach, lag(s) OVER (PARTITION BY event_type ORDER BY s, e, event_id) AS ps, lag(e) OVER (PARTITION BY event_type ORDER BY s, e, event_id) AS pe FROM {_ROWS}),
    b AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR {new} THEN 1 ELSE 0 END) OVER ({order} CURRENT ROW) AS BIGINT) AS cluster_id FROM a)
    SELECT event_type, cluster_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM b GROUP BY event_type, cluster_id"""


def _depth_sql(key: str, rows: str, low: str, high: str, having: str) -> str:
    return f"""
    WITH c AS (SELECT {key}, {low} AS pos, 1 AS x FROM {rows} WHERE {low} < {high} UNION ALL SELECT {key}, {high}, -1 FROM {rows} WHERE {low} < {high}),
    s AS (SELECT {key}, pos, sum(x) AS x FROM c GROUP BY {key}, pos {having}),
    t AS (SELECT {key}, pos AS start, lead(pos) OVER (PARTITION BY {key} ORDER BY pos) AS "end", CAST(sum(x) OVER (PARTITION BY {key} ORDER BY pos) AS BIGINT) AS depth FROM s)"""


QUERIES = {f.__name__: f for f in (type_clusters, type_clusters_overlapping, type_clusters_bridged, type_chains, type_coverage, flag_pieces)}
ORACLE_SQL = {
    "type_clusters": _spans_sql("s > reach"),
    "type_clusters_overlapping": _spans_sql("s >= reach"),
    "type_clusters_bridged": _spans_sql("s > reach + 300"),
    "type_chains": _spans_sql("s - ps > 400 OR e - pe > 400"),
    "type_coverage": _depth_sql("event_type", _ROWS, "s", "e", "HAVING sum(x) <> 0") + ' SELECT event_type, start, "end", depth FROM t WHERE depth <> 0 AND "end" IS NOT NULL',
    "flag_pieces": _depth_sql("l_returnflag", SHIPMENTS_SQL, "d", "f", "") + ' SELECT l_returnflag, start, "end", row_number() OVER (PARTITION BY l_returnflag ORDER BY start) AS piece FROM t WHERE depth > 0 AND "end" IS NOT NULL',
}
