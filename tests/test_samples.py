import pytest
from pyspark.sql import functions as F

from strandloom.functions.text import joined_pieces
from strandloom.sources.samples import sample_groups


def test_files_and_folders_are_samples(spark, tmp_path):
    for name in ("a/x.bam", "b/x.sam", "run/2.BAM", "run/10.sam", "run/notes.txt", "x.bam", "empty/readme"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    at = lambda *names: [str(tmp_path / n) for n in names]
    assert sample_groups(spark, at("a/x.bam", "run", "b/x.sam", "x.bam")) == [("x", at("a/x.bam")), ("run", at("run/10.sam", "run/2.BAM")), ("x_2", at("b/x.sam")), ("x_3", at("x.bam"))]
    with pytest.raises(ValueError, match="does not exist"):
        sample_groups(spark, at("none.bam"))
    with pytest.raises(ValueError, match="no BAM or SAM"):
        sample_groups(spark, at("empty"))


def test_touching_pieces_are_joined(spark):
    schema = "k int, p array<struct<start:bigint,end:bigint>>"
    rows = [(1, [(30, 40), (0, 10), (10, 20), (20, 25)]), (2, []), (3, [(5, 6)]), (4, None), (5, [(0, 10), (5, 12)])]
    got = {r.k: None if r.e is None else [tuple(x) for x in r.e] for r in spark.createDataFrame(rows, schema).select("k", joined_pieces(F.col("p")).alias("e")).collect()}
    assert got == {1: [(0, 25), (30, 40)], 2: [], 3: [(5, 6)], 4: None, 5: [(0, 10), (5, 12)]}
