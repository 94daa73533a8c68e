import random

import pytest

from strandloom.operators import intervals, scans


@pytest.fixture
def spans(spark):
    def make(seed, n=300):
        rng = random.Random(seed)
        rows = []
        for k in range(n):
            a = rng.choice([rng.randrange(-200, 2000), 500])
            rows.append((rng.choice(["x", "x", "y", None]), a, a + rng.choice([0, 1, 3, 8, 400 if rng.random() < 0.05 else 5]), k, "z"))
        return spark.createDataFrame(rows, "g string, s long, e long, k long, extra string")

    return make


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("width", [7, 100, 100_000])
def test_bins_give_what_one_scan_a_key_gives(spans, width):
    df = spans(width)
    for gap, touching in ((0, True), (-1, False)):
        want = intervals.cluster_intervals(df, ["g"], "s", "e", ["e", "k"], touching=touching)
        assert listed(scans.cluster_by_bins(df, ["g"], "s", "e", ["e", "k"], width=width, gap=gap), "k", "cluster_id") == listed(want, "k", "cluster_id")
    assert listed(scans.coverage_by_bins(df, ["g"], "s", "e", width=width), "g", "start", "end", "depth") == listed(intervals.coverage_segments(df, ["g"], "s", "e"), "g", "start", "end", "depth")
    assert listed(scans.pieces_by_bins(df, ["g"], "s", "e", width=width), "g", "start", "end", "piece") == listed(intervals.disjoint_pieces(df, ["g"], "s", "e"), "g", "start", "end", "piece")


def test_chains_and_bridges_equal_a_walk(spans):
    df = spans(1)
    rows = sorted(((r.g or "", r.s, r.e, r.k) for r in df.collect()))
    chains, bridges, at = {}, {}, {}
    for g, s, e, k in rows:
        last, far, c, b = at.get(g, (None, None, 0, 0))
        c += last is None or s - last[0] > 9 or e - last[1] > 9
        b += far is None or s > far + 9
        at[g] = ((s, e), e if far is None else max(far, e), c, b)
        chains[k], bridges[k] = c, b
    assert dict(listed(scans.chain_by_bins(df, ["g"], "s", "e", ["e", "k"], width=50, window=9), "k", "cluster_id")) == chains
    assert dict(listed(scans.cluster_by_bins(df, ["g"], "s", "e", ["e", "k"], width=50, gap=9), "k", "cluster_id")) == bridges


def test_no_task_holds_a_key(spark):
    df = spark.range(20_000).selectExpr("'one' AS g", "id * 10 AS s", "id * 10 + 5 AS e", "id AS k")
    found = scans.cluster_by_bins(df, ["g"], "s", "e", ["k"], width=5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = found.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 20_000 * 0.7


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, s long, e long, k long")
    assert scans.cluster_by_bins(df, ["g"], "s", "e", ["k"], width=5).count() == scans.chain_by_bins(df, ["g"], "s", "e", ["k"], width=5, window=1).count() == 0
    assert scans.coverage_by_bins(df, ["g"], "s", "e", width=5).count() == scans.pieces_by_bins(df, ["g"], "s", "e", width=5).count() == 0
