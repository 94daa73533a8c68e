import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.operators.dedup import deduplicate

SCHEMA = "qname string, flag int, cigar string, cell string, molecule string, path string, line long"


def frame(spark, rows):
    rows = spark.createDataFrame(rows, SCHEMA).withColumn("ops", cigar.operations(F.col("cigar")))
    tags = F.map_filter(F.create_map(F.lit("CB"), "cell", F.lit("UB"), "molecule"), lambda _, v: v.isNotNull())
    return rows.withColumn("tags", tags).drop("cell", "molecule")


def test_longest_span_then_name_then_place(spark):
    rng = random.Random(5)
    rows = [(f"q{rng.randrange(6)}", rng.choice([0, 16, 0x4, 0x100, 0x800]), f"{rng.choice([5, 9])}M{rng.choice([10, 20])}N{rng.choice([5, 9])}M", f"c{rng.randrange(3)}", f"u{rng.randrange(3)}", rng.choice("ab"), i) for i in range(120)]
    span = lambda c: sum(int(x) for x in c.replace("M", " ").replace("N", " ").split())
    want = {}
    for r in sorted(rows, key=lambda r: (-span(r[2]), r[0], r[5], r[6])):
        if not r[1] & 0x904:
            want.setdefault((r[3], r[4]), r[6])
    found = deduplicate(frame(spark, rows)).select("cell", "molecule", "line").collect()
    assert {(r.cell, r.molecule): r.line for r in found} == want and len(found) == len(want)


def test_missing_tags_are_an_error_only_where_kept(spark):
    gone = [("q", 0x100, "5M", None, None, "a", 1), ("q", 0x4, "*", None, None, "a", 2)]
    assert deduplicate(frame(spark, gone)).count() == 0
    with pytest.raises(Exception, match="q has no tag UB"):
        deduplicate(frame(spark, [*gone, ("q", 0, "5M", "c", None, "a", 3)])).collect()
