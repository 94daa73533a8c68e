import random

import pytest

from strandloom.operators import ordinals, ranks


def by_hand(values):
    """(Holm, Benjamini-Hochberg) of each value, from the definitions."""
    known = sorted((p, i) for i, p in enumerate(values) if p is not None)
    n = len(known)
    holm, bh = [None] * len(values), [None] * len(values)
    top, low = 0.0, 1.0
    for rank, (p, i) in enumerate(known, 1):
        top = max(top, min(1.0, p * (n - rank + 1)))
        holm[i] = top
    for rank, (p, i) in reversed(list(enumerate(known, 1))):
        low = min(low, p * n / rank)
        bh[i] = low
    return holm, bh


@pytest.mark.parametrize("parts", [1, 4])
def test_adjustments_keep_nulls_and_ties(spark, parts):
    rng = random.Random(3)
    values = [rng.choice([None, 1.0, 1.0, 1.0, 0.01, round(rng.random(), 2), rng.random() / 50]) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(values)), "i long, p double")
    want = by_hand(values)
    for k, adjust in enumerate((ranks.holm, ranks.benjamini_hochberg)):
        found = {r.i: r.adjusted for r in adjust(frame, "p", "i", parts=parts).collect()}
        assert len(found) == len(values)
        for i, w in enumerate(want[k]):
            assert found[i] == (None if w is None else pytest.approx(w))


def test_adjusting_nothing_and_nulls_only(spark):
    empty = spark.createDataFrame([], "i long, p double")
    assert ranks.holm(empty, "p").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "i long, p double")
    assert [r.adjusted for r in ranks.benjamini_hochberg(nulls, "p").collect()] == [None, None]


def test_ordinals_and_average_ranks_keep_nulls(spark):
    values = [None, 3.0, 1.0, 3.0, 3.0, None, 2.0]
    frame = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    rows = {r.i: r.ordinal for r in ordinals.global_row_number(frame, "v", ["i"], parts=3).collect()}
    assert rows == {0: 1, 5: 2, 2: 3, 6: 4, 1: 5, 3: 6, 4: 7}
    dense = {r.i: r.ordinal for r in ordinals.global_dense_rank(frame, "v", parts=3).collect()}
    assert dense == {0: 1, 5: 1, 2: 2, 6: 3, 1: 4, 3: 4, 4: 4}
    average = {r.v: r.avg_rank for r in ranks.average_ranks(frame.where("v IS NOT NULL"), "v").collect()}
    assert average == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}
