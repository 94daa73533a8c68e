"""Samples named on a command line: an alignment file each, or a folder of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

#: The endings of alignment files, in any case.
ENDINGS = (".bam", ".sam")


def sample_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(sample, files) of each path, in order: a file is a sample named by its stem, a folder one of all its alignment files, sorted.

    A name that is taken gets ``_2``, ``_3`` and so on. A missing path and a folder without alignment
    files are errors. Names and listings are read from whatever store the paths are in.
    """
    names: set[str] = set()
    found = []
    for text in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise ValueError(f"alignment path {text} does not exist")
        folder = fs.getFileStatus(path).isDirectory()
        inside = [s for s in fs.listStatus(path) if s.isFile()] if folder else []
        files = sorted(f"{text.rstrip('/')}/{s.getPath().getName()}" for s in inside if s.getPath().getName().lower().endswith(ENDINGS)) if folder else [text]
        if not files:
            raise ValueError(f"folder {text} holds no BAM or SAM files")
        stem = path.getName() if folder else path.getName().rpartition(".")[0] or path.getName()
        name = next(n for k in range(1, len(names) + 2) if (n := stem if k == 1 else f"{stem}_{k}") not in names)
        names.add(name)
        found.append((name, files))
    return found
