"""Every query with SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from strandloom.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for f in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return sorted(zip(*(map(repr, table.column(c).to_pylist()) for c in names), strict=True)), names


@pytest.mark.skipif(not SF.exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, str(SF)).toArrow()
    assert rows(ours) == rows(duck.execute(registry.ORACLE_SQL[name]).to_arrow_table())
