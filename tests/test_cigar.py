import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as C


def test_exon_lists_equal_the_fold(spark):
    rng = random.Random(9)
    texts = ["", "*", None, "5N", "3N4N", "10M", "2H3S7=1X2I4D9N8M1P", "1N1M", "007M03N1M", "4m3N2M", "M5M", "123456789012M1N"]
    texts += ["".join(f"{rng.randrange(1, 500)}{rng.choice('MIDNSHP=XNM')}" for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    rows = [(k, rng.randrange(10**6) if k % 17 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, pos long, cigar string").repartition(3)
    wrong = df.select("id", C.exons(F.col("pos"), C.operations(F.col("cigar"))).alias("a"), C.exons_of(F.col("pos"), F.col("cigar")).alias("b")).where("pos is not null and cigar is not null and not a <=> b").collect()
    assert wrong == []
    missing = df.select(C.exons_of(F.col("pos"), F.col("cigar")).alias("b"), "pos", "cigar").where("(pos is null or cigar is null) and b is not null").count()
    assert missing == 0


def test_exon_lists_of_slices_and_empty_batches():
    starts, texts = pa.array([1, 2, 3, 4]), pa.array(["9M", "5M2N5M", None, "1M1N1M1N1M"])
    whole = C.exon_lists(starts, texts).to_pylist()
    assert whole[1] == [{"start": 2, "end": 7}, {"start": 9, "end": 14}] and whole[2] is None
    assert C.exon_lists(starts[1:], texts[1:]).to_pylist() == whole[1:]
    assert C.exon_lists(starts[:0], texts[:0]).to_pylist() == []


def test_a_length_without_a_letter_is_an_error():
    with pytest.raises(ValueError, match="ends with a length: 5M3"):
        C.exon_lists(pa.array([1, 1]), pa.array(["4M", "5M3"]))
