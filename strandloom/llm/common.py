"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python: whole texts travel, so batches are kept small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, read by Spark alone (any store will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that a worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where unset (local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a staged frame that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) of a table; other columns, whatever their names, stay behind. Null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def text_key(col: str):
    """A 64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")))


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary()).to_pylist()


def crc_mod(col: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def sorted_groups(batches, keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal first ``keys`` columns, across batches; rows come sorted."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(n - 1, dtype=bool)
        for column in columns:
            change |= column[1:] != column[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(column[a].item() for column in columns)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
