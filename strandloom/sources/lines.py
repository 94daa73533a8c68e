"""Text lines with their place in the file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Files(InputPartition):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first


class _LineReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Files]:
        return [_Files(p, 0) for p in self.paths]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path}")
        with system.open_input_stream(path, compression="detect") as f:
            number, rest = 0, b""
            while chunk := f.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    number += 1
                    yield partition.path, number, line.rstrip(b"\r").decode()
            if rest:
                yield partition.path, number + 1, rest.rstrip(b"\r").decode()


class NumberedLines(DataSource):
    """``numbered_lines``: (path, line, text) of text files (gzip by name), one partition a file.

    Line numbers are part of error messages and of first-seen rules, and a line's number cannot be
    known from the middle of a file; so a file is read by one task, streaming.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "path string, line long, text string"

    def reader(self, schema) -> _LineReader:
        import json

        return _LineReader(json.loads(self.options["paths"]))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    import json

    spark.dataSource.register(NumberedLines)
    return spark.read.format("numbered_lines").option("paths", json.dumps(paths)).load()


def columns(lines: DataFrame, *, at_least: int, what: str, exactly: bool = False) -> DataFrame:
    """Tab-split lines as array ``f``; too few (or other than ``at_least``) columns are an error with path and line."""
    split = F.split("text", "\t", -1)
    n = F.size(split)
    wrong = n != at_least if exactly else n < at_least
    message = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(f": {what} needs {at_least} columns, found "), n.cast("string"))
    return lines.withColumn("f", F.when(wrong, F.raise_error(message)).otherwise(split))


def whole_number(column, what: str):
    """A trimmed integer; anything else is an error with path and line."""
    number = F.expr(f"try_cast(trim({column}) AS BIGINT)") if isinstance(column, str) else F.trim(column).try_cast("bigint")
    text = F.expr(column) if isinstance(column, str) else column
    message = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(f": bad {what}: "), text)
    return F.when(number.isNull(), F.raise_error(message)).otherwise(number)
