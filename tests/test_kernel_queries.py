from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from strandloom.kernels import peaks
from strandloom.operators.streams import key_groups
from strandloom.plans import kernel_queries
from strandloom.plans.tables import shipments

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="test tables are absent")
def test_kernel_queries_run(spark):
    assert kernel_queries.end_peaks(spark, str(SF)).count() >= 10
    assert kernel_queries.coverage_exons(spark, str(SF)).count() >= 1
    assert kernel_queries.change_points(spark, str(SF)).columns == ["user_id", "pos", "start", "end", "sign"]
    widest = kernel_queries.widest_paths(spark, str(SF))
    assert widest.columns == ["event_type", "rank", "nodes", "expr"]
    assert widest.where("rank = 1").count() == widest.select("event_type").distinct().count() == 5


@pytest.mark.skipif(not SF.exists(), reason="test tables are absent")
def test_assembled_orders_cover_what_their_exons_cover(spark):
    from strandloom.operators.assembly import assemble_transfrags
    from strandloom.plans import assembly_queries

    frags = assembly_queries._transfrags(spark, str(SF)).where("id < 800")
    found = assemble_transfrags(frags)
    want = frags.selectExpr("inline(exons)", "expr").selectExpr("sum((end - start) * expr)").first()[0]
    assert found.coverage.selectExpr("sum((end - start) * value)").first()[0] == pytest.approx(want, rel=1e-6)
    isoforms = found.isoforms.collect()
    assert sorted(r.transcript for r in isoforms) == list(range(1, len(isoforms) + 1))
    assert {r.gene for r in isoforms} == set(range(1, len({r.gene for r in isoforms}) + 1))
    assert {r.tss for r in isoforms} == set(range(1, len({r.tss for r in isoforms}) + 1))


@pytest.mark.skipif(not SF.exists(), reason="test tables are absent")
def test_end_peaks_stream_flat_rows(spark):
    rows = [(r.l_suppkey, r.d, r.f) for r in shipments(spark, str(SF)).collect()]
    want = [(s, a, b, float(n)) for s in {r[0] for r in rows} for a, b, n in peaks.chain_ends(Counter(r[1:] for r in rows if r[0] == s), peaks.PeakSettings(support=0.1), junctions=(float("inf"), float("-inf")))]
    found = kernel_queries.end_peaks(spark, str(SF))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # a supplier's ends must not travel as one array: a batch would hold thousands of suppliers' ends
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_key_groups_run_across_batches():
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in rows], pa.schema([("k", pa.string()), ("v", pa.int64())]))
    found = key_groups([batch((None, 1), ("a", 2)), batch(), batch(("a", 3)), batch(("a", 4), ("b", 5)), batch(("c", 6))], ["k"])
    assert [(k, t.column("v").to_pylist()) for (k,), t in found] == [(None, [1]), ("a", [2, 3, 4]), ("b", [5]), ("c", [6])]
