import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.numbers import double_text, float_text


def test_random_bit_patterns_of_doubles(spark):
    bits = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64).view(np.float64).tolist()
    values = [v for v in bits if not math.isnan(v)] + [0.0, -0.0, 0.1, 1e6, 1e22, 5e-324, 123456.789, 1e16]
    got = {r.v: r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", double_text(F.col("v")).alias("t")).collect()}
    for v, t in got.items():
        assert float(t) == v and "e" not in t.lower() and "." in t
        digits = lambda s: s.replace("-", "").replace(".", "").strip("0")
        assert len(digits(t)) == len(digits(repr(v).split("e")[0]))  # as few digits as the shortest that round-trip


def test_random_bit_patterns_of_floats(spark):
    bits = np.random.default_rng(2).integers(0, 2**32, 3000, dtype=np.uint32).view(np.float32)
    values = [float(v) for v in bits if np.isfinite(v)] + [float(np.float32(x)) for x in (0.1, 1 / 3, 1e6, 16777216, 123456790528, 2.5, 0.85)]
    got = {r.v: r.t for r in spark.createDataFrame([(v,) for v in values], "v float").select("v", float_text(F.col("v")).alias("t")).collect()}
    for v, t in got.items():
        assert np.float32(t) == np.float32(v) and "e" not in t
        k = len(t.split(".")[1])
        if k <= 11:
            assert t == f"{v:.{k}f}" and (k == 1 or np.float32(f"{v:.{k - 1}f}") != np.float32(v))


@pytest.mark.parametrize("text", [double_text, float_text])
def test_names_and_nulls(spark, text):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.0,)]
    kind = "double" if text is double_text else "float"
    assert [r[0] for r in spark.createDataFrame(rows, f"v {kind}").select(text(F.col("v"))).collect()] == ["nan", "inf", "-inf", None, "1.0"]
