"""Queries of the library's own operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly_queries, group_queries, interval_queries, kernel_queries, scalar_queries, scan_queries, selection_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (assembly_queries, interval_queries, group_queries, scalar_queries, kernel_queries, scan_queries, selection_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
