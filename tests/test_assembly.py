import random
import subprocess
import sys

import numpy as np
import pytest

from strandloom.kernels.isoforms import AssemblySettings
from strandloom.operators import assembly as A
from strandloom.operators.components import connected_components
from strandloom.sinks import assembly as lines
from strandloom.sinks.files import join_parts, read_file, write_files

SCHEMA = "sample string, sample_ord long, ord long, id string, chrom string, strand string, exons array<struct<start:long,end:long>>, expr double, is_ref boolean, part string"


@pytest.fixture
def frags(spark):
    """Transfrags from (sample, chrom, strand, exons, expr) rows, with an extra column whose name clashes."""

    def make(rows):
        made = [(str(r[0]), r[0], k, f"{r[0]}.{k + 1}", r[1], r[2], list(r[3]), float(r[4]), False, "x") for k, r in enumerate(rows)]
        return spark.createDataFrame(made, SCHEMA)

    return make


THREE = [(99, 300), (399, 600), (799, 1000)]


def test_three_exons_and_their_files(spark, frags, tmp_path):
    checked = A.checked_transfrags(frags([(1, "c1", "+", THREE, 4), (1, "c1", "+", [(2000, 2050)], 4)])).cache()
    found = A.assemble_transfrags(checked.where("keep").drop("too_short", "too_weak", "bad_introns", "keep"))
    (one,) = found.isoforms.collect()
    assert (one.chrom, one.strand, one.locus, one.gene, one.tss, one.transcript) == ("c1", "+", 1, 1, 1, 1)
    assert [tuple(e) for e in one.exons] == THREE and (one.flow, one.share, one.gene_share) == (5e5, 1.0, pytest.approx(1.0))
    samples = spark.createDataFrame([(1, "a.gtf", "1")], "ord long, path string, sample string")
    target = str(tmp_path / "out")
    lines.write_assembly(found, checked, samples, A.sample_stats(checked), target, source="asm")
    text = {name: [r.line for r in sorted(read_file(spark, target, name).collect(), key=lambda r: (r.part, r.ord))] if any((tmp_path / "out" / name).glob("part-*")) else [] for name in lines.FILES}
    ids = 'locus_id "L1"; gene_id "G1"; tss_id "TSS1"; transcript_id "TU1";'
    exon = lambda a, b: f"c1\tasm\texon\t{a + 1}\t{b}\t1000\t+\t.\t{ids}"
    assert text["assembly.gtf"] == [f'c1\tasm\ttranscript\t100\t1000\t1000\t+\t.\texpr "500000.000"; rel_frac "1.00000"; abs_frac "1.00000"; {ids}', *(exon(*e) for e in THREE)]
    assert text["assembly.bed"] == ["c1\t99\t1000\tG1|TU1(500000.0)\t1000\t+\t99\t99\t0\t3\t201,201,201,\t0,300,700,"]
    assert text["transfrags.bed"] == ["c1\t99\t1000\t1.1\t500000.0\t+\t0\t0\t0\t3\t201,201,201\t0,300,700"]
    assert [t.split("\t")[3] for t in text["transfrags.filtered.bed"]] == ["1.2"]
    assert text["loci.txt"] == ["L1\tc1\t99\t1000\t0\t1"]
    assert text["expr.pos.bedgraph"] == [f"c1\t{a}\t{b}\t500000.000000" for a, b in THREE]
    assert text["expr.neg.bedgraph"] == text["expr.none.bedgraph"] == text["change_points.gtf"] == []
    assert text["splice_junctions.bed"][1:] == ["c1\t299\t400\tJUNC\t500000.0\t+\t299\t400\t255,0,0\t2\t1,1\t0,100", "c1\t599\t800\tJUNC\t500000.0\t+\t599\t800\t255,0,0\t2\t1,1\t0,200"]
    assert text["splice_graph.gtf"][0] == 'c1\tasm\tnode\t100\t300\t0\t+\t.\tgraph_id "G_c1_99_1000_+"; expr_min "500000.0"; expr_max "500000.0"; expr_mean "500000.0"; ref_starts ""; ref_stops "";'
    row = lambda k, n, chosen: f"c1\t99\t1000\t+\t{k}\t3\t1\t0\t0.0\t0\t0.0\t{n}\t0\t500000.0\t500000.0\t1.0\t1\t{n}\t{chosen}"
    assert text["path_graph_stats.txt"][1:] == [row(1, 3, 0), row(2, 2, 0), row(3, 1, 0), row(1, 3, 1)]
    assert text["samples.txt"] == ["gtf\tsample_id", "a.gtf\t1"] and text["sample_stats.txt"][1] == "1\t2\t1\t0\t0"
    with pytest.raises(ValueError, match="exists already"):
        lines.write_assembly(found, checked, samples, A.sample_stats(checked), target)


def test_two_samples_add_up_and_minus_exons(frags):
    rows = [(s, "c1", "+", THREE, 4) for s in (1, 2)] + [(s, "c2", "-", [(99, 400)], 4) for s in (1, 2)]
    found = A.assemble_transfrags(A.checked_transfrags(frags(rows)))
    got = sorted((r.chrom, r.strand, [tuple(e) for e in r.exons], r.flow, r.gene, r.transcript) for r in found.isoforms.collect())
    assert got == [("c1", "+", THREE, 1e6, 1, 1), ("c2", "-", [(99, 400)], 1e6, 2, 2)]
    assert {(r.start, r.value) for r in found.coverage.where("chrom = 'c1'").collect()} == {(a, 1e6) for a, _ in THREE}
    assert {r.expr for r in found.junctions.collect()} == {1e6}
    assert [r.n for r in found.loci.orderBy("locus").collect()] == [2, 2]


def imputed(rows):
    """Strands by rounds over all pairs."""
    strand, rounds = {k: r[2] for k, r in enumerate(rows)}, {k: 0 if r[2] != "." else None for k, r in enumerate(rows)}
    meet = lambda a, b: rows[a][1] == rows[b][1] and any(x[0] < y[1] and y[0] < x[1] for x in rows[a][3] for y in rows[b][3])
    turn = 0
    while True:
        turn += 1
        near = {k: {strand[j] for j in strand if strand[j] != "." and meet(k, j)} for k in strand if strand[k] == "."}
        new = {k: s.pop() for k, s in near.items() if len(s) == 1}
        if not new:
            return strand, rounds
        for k, s in new.items():
            strand[k], rounds[k] = s, turn


@pytest.mark.parametrize("seed", range(3))
def test_strands_equal_rounds_over_all_pairs(frags, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        a = rng.randrange(400)
        exons = [(a, a + rng.randrange(1, 9))] + ([(a + 12, a + 16)] if rng.random() < 0.4 else [])
        rows.append((1, rng.choice(["c1", "c2"]), rng.choice("+-......"), exons, 1))
    strand, rounds = imputed(rows)
    assert max(r or 0 for r in rounds.values()) > 1
    got = {r.ord: (r.strand, r.round) for r in A.impute_strands(frags(rows), ["chrom"], width=16).collect()}
    assert got == {k: (strand[k], rounds[k]) for k in strand}


def test_an_unstranded_transfrag_takes_the_only_strand_and_is_assembled(frags):
    found = A.assemble_transfrags(A.checked_transfrags(frags([(1, "c1", "+", [(99, 400)], 4), (1, "c1", ".", [(99, 400)], 4), (1, "c1", ".", [(900, 1300)], 4)])))
    assert [(r.strand, r.flow) for r in found.isoforms.collect()] == [("+", pytest.approx(2e6 / 3))]
    assert sorted((r.strand, r.start) for r in found.coverage.collect()) == [("+", 99), (".", 900)]
    both = A.assemble_transfrags(found.frags.drop("start", "end", "locus", "round"), AssemblySettings(unstranded=True))
    assert sorted(r.strand for r in both.isoforms.collect()) == ["+", "."]


def test_units_separate_what_shares_no_stretch(frags):
    # the second lies in the first one's intron, the third links stretches of its own, the fourth touches the second
    rows = [(1, "c1", "+", [(0, 10), (100, 110)], 1), (1, "c1", "+", [(40, 50)], 1), (1, "c1", "+", [(60, 70), (80, 90)], 1), (1, "c1", "+", [(50, 55)], 1), (1, "c1", "-", [(0, 110)], 1)]
    units = {r.ord: r.unit for r in A.with_units(A.with_loci(frags(rows))).collect()}
    assert len(set(units.values())) == 4 and units[1] == units[3]


def test_numbers_run_through_loci_strands_and_genes(frags):
    one = lambda c, s, a: (1, c, s, [(a, a + 300), (a + 400, a + 700)], 5)
    rows = [one("c2", "+", 0), one("c1", "-", 1000), one("c1", "+", 900), (1, "c1", "+", [(800, 1200), (1300, 1600)], 3), (1, "c1", "+", [(950, 1200), (1450, 1600)], 4)]
    found = A.assemble_transfrags(frags(rows)).isoforms.orderBy("transcript").collect()
    assert [r.transcript for r in found] == list(range(1, len(found) + 1))
    assert [r.gene for r in found] == sorted(r.gene for r in found) and found[-1].chrom == "c2" and found[-1].locus == 2
    sites = {}
    for r in found:  # a site is numbered as it first comes up in its gene
        pos = r.exons[-1].end if r.strand == "-" else r.exons[0].start
        sites.setdefault((r.gene, pos), len(sites) + 1)
        assert r.tss == sites[(r.gene, pos)]


def test_empty_tables_and_repeated_rows(frags):
    empty = A.assemble_transfrags(frags([]))
    assert empty.isoforms.count() == empty.coverage.count() == empty.loci.count() == 0
    rows = [(1, "c1", "+", THREE, 2)] * 3 + [(1, "c1", "+", [], 2)]
    found = A.assemble_transfrags(frags(rows))
    assert [r.flow for r in found.isoforms.collect()] == [6.0] and found.tried.first().transfrags == 3


def test_components_equal_a_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + k, 201 + k) for k in range(40)] + [(7, 7), (None, 3)]
    near = {}
    for a, b in edges:
        if a is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if want.setdefault(x, n) == n:
                todo += [y for y in near[x] if y not in want]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_files_keep_their_order(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'a.txt', 'b.txt') AS file", "id * 7 % 5000 AS k", "cast(id * 7 % 5000 AS string) AS line")
    write_files(rows, str(tmp_path / "out"), ["a.txt", "b.txt", "none.txt"], "k", headers={"a.txt": "top"})
    for name, keep in (("a.txt", lambda i: i % 3 == 0), ("b.txt", lambda i: i % 3)):
        got = [r.line for r in sorted(read_file(spark, str(tmp_path / "out"), name).collect(), key=lambda r: (r.part, r.ord))]
        want = [str(k) for k in sorted(i * 7 % 5000 for i in range(5000) if keep(i))]
        assert got == (["top", *want] if name == "a.txt" else want)
        join_parts(spark, str(tmp_path / "out"), name, str(tmp_path / f"one-{name}"))
        assert (tmp_path / f"one-{name}").read_text().splitlines() == got
    assert list((tmp_path / "out" / "none.txt").glob("part-*")) == []
    with pytest.raises(Exception, match="no such output file"):
        write_files(rows, str(tmp_path / "other"), ["a.txt"], "k")


LOST_TASK = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from strandloom.sinks.files import write_files

root = Path(sys.argv[1])
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()

@F.udf("string")
def fails_once(k):
    if k == 900 and not (root / "failed").exists():
        (root / "failed").touch()
        raise RuntimeError("lost")
    return str(k)

rows = spark.range(1000).select(F.lit("a.txt").alias("file"), F.col("id").alias("k"), F.col("id").cast("string").alias("line"))
write_files(rows.repartition(3).select("file", "k", fails_once("k").alias("line")), str(root / "out"), ["a.txt"], "k")
"""


def test_files_of_a_job_that_lost_a_task_are_whole(tmp_path):
    subprocess.run([sys.executable, "-c", LOST_TASK, str(tmp_path)], check=True, timeout=180, capture_output=True)
    assert (tmp_path / "failed").exists()
    parts = sorted((tmp_path / "out" / "a.txt").glob("part-*"))
    assert [x for p in parts for x in p.read_text().split()] == [str(k) for k in range(1000)]


@pytest.mark.parametrize("whole, settings", [(4096, AssemblySettings()), (25, AssemblySettings(unstranded=True, change_points=False)), (0, AssemblySettings())])
def test_whole_chromosomes_equal_tables(frags, monkeypatch, whole, settings):
    monkeypatch.setattr(A, "WHOLE", whole)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        edges = np.sort(rng.choice(60, 2 * int(rng.integers(1, 4)), replace=False)) * 20 + int(rng.integers(0, 3)) * 900
        rows.append((int(rng.integers(1, 3)), f"c{int(rng.integers(0, 5)) ** 2 // 4}", "+-..."[int(rng.integers(0, 5))], [(int(a), int(b)) for a, b in edges.reshape(-1, 2)], int(rng.integers(1, 9))))
    rows += [(1, "d", ".", [(5, 9)], 1), (1, "e", "-", [(5, 9), (9, 12)], 2), (1, "e", "+", [(12, 19)], 2), (2, "e", "-", [(5, 9), (9, 12)], 2)]
    table = frags(rows)
    want, found = (sorted((r.transcript, r.chrom, r.strand, r.locus, r.gene, r.tss, [tuple(e) for e in r.exons], round(r.flow, 3), round(r.share, 5), round(r.gene_share, 5)) for r in f.collect()) for f in (A.assemble_transfrags(table, settings).isoforms, A.assembled_isoforms(table, settings)))
    assert found == want and len(found) > 20


def test_whole_chromosomes_of_no_rows(frags):
    assert A.assembled_isoforms(frags([])).count() == 0
