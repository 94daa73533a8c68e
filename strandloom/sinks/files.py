"""Several ordered text files from one frame of lines, written by the tasks and committed by Spark.

Each file is a folder of parts whose names sort in the order of its lines, as for any Spark output.
Spark's committer moves a task's parts into place when the job commits, so lost tasks and second
attempts leave nothing behind, and no line passes the driver. ``join_parts`` makes one file of a
folder's parts by copying bytes between streams.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(lines: DataFrame, path: str, files: Sequence[str], *order: str, headers: dict[str, str] | None = None) -> None:
    """Write ``lines`` (file, line, order columns) as ``path/<file>/part-...``, files without lines too; ``path`` must not exist.

    A header is the file's first line. Lines of files that are not named are an error.
    """
    spark = lines.sparkSession
    fs, root = _path(spark, path)
    if fs.exists(root):
        raise ValueError(f"output folder {path} exists already")
    known = F.col("file").isin(*files)
    named = lines.withColumn("file", F.when(known, F.col("file")).otherwise(F.raise_error(F.concat(F.lit("no such output file: "), F.coalesce("file", F.lit("null"))))))
    rows = named.select("file", F.lit(1).alias("_body"), *order, "line")
    if headers:
        head = spark.createDataFrame(list(headers.items()), "file string, line string").withColumn("_body", F.lit(0))
        rows = rows.unionByName(head, allowMissingColumns=True)
    keys = ["file", "_body", *order]
    scratch = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("file", F.col("line").alias("value"))
    dealt.write.partitionBy("file").text(scratch)
    _, made = _path(spark, scratch)
    fs.mkdirs(root)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in files:
        inside, target = path_of(made, f"file={name}"), path_of(root, name)
        if not (fs.exists(inside) and fs.rename(inside, target)):
            fs.mkdirs(target)
    fs.create(path_of(root, "_SUCCESS")).close()
    fs.delete(made, True)


def read_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(part, ord, line): a file's lines with the part and the place that give their order."""
    lines = spark.read.text(f"{path}/{name}", pathGlobFilter="part-*")
    return lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def join_parts(spark: SparkSession, path: str, name: str, target: str) -> None:
    """One file of a folder's parts, byte by byte through two streams; constant memory, no rows."""
    fs, folder = _path(spark, f"{path}/{name}")
    out_fs, out_path = _path(spark, target)
    jvm = spark.sparkContext._jvm
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = out_fs.create(out_path)
    try:
        for part in parts:
            source = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    finally:
        out.close()


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
