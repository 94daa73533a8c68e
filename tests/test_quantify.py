import numpy as np
import pytest

from strandloom.kernels import novel, placement
from strandloom.kernels.placement import GeneModel, MatchSettings
from strandloom.operators import quantify
from strandloom.sources import alignments, annotations

S = MatchSettings()


def gene(bounds=((0, 100), (200, 300), (400, 500)), isoforms=((1, 1, 1), (1, 0, 1)), strand="+", start=0, end=500):
    return GeneModel("g", start, end, strand, np.array(bounds), np.array(isoforms, dtype=bool))


def test_cover_and_rounding():
    assert placement.covered(np.array([(50, 120), (210, 260)]), gene().bounds).tolist() == [50, 50, 0]
    assert placement.half_even(np.array([0.125, 0.135, 0.666])).tolist() == [0.12, 0.14, 0.67]


@pytest.mark.parametrize(
    ("counts", "tailed", "strand", "kind", "isoform", "vector"),
    [
        ([100, 100, 100], False, "+", "known", 0, [1, 1, 1]),
        ([100, 0, 100], False, "+", "known", 1, [1, -1, 1]),
        ([45, 100, 100], False, "+", "known", 0, [0, 1, 1]),
        ([0, 100, 100], False, "+", "known", 0, [0, 1, 1]),
        ([100, 100, 0], True, "+", "novel", -1, [1, 1, -1]),
        ([0, 0, 0], False, "+", "uncategorized", -1, None),
        ([30, 0, 0], False, "+", "known", 1, [1, 0, 0]),
    ],
)
def test_assign(counts, tailed, strand, kind, isoform, vector):
    found = placement.assign(gene(strand=strand), np.array(counts), S, tailed)
    assert found[:2] == (kind, isoform)
    assert (None if found[2] is None else found[2].tolist()) == vector


def test_small_exons_are_forgiven_step_by_step():
    g = gene(bounds=((0, 100), (200, 230), (400, 500)), isoforms=((1, 1, 1),))
    assert placement.assign(g, np.array([100, 0, 100]), S, False)[0] == "known"
    assert placement.assign(gene(isoforms=((1, 1, 1),)), np.array([100, 0, 100]), S, False)[0] == "novel"


def test_place_prefers_known_then_bases():
    a, b = gene(isoforms=((1, 1, 1),)), gene(bounds=((0, 100), (400, 500)), isoforms=((1, 1),))
    blocks = np.array([(0, 100), (400, 500)])
    assert placement.place([a, b], [False, False], blocks, 0, 500, S)[:2] == (1, "known")
    assert placement.place([a, gene(end=900)], [False] * 2, np.array([(120, 150)]), 120, 150, S)[0] == 1
    assert placement.place([], [], blocks, 0, 500, S) is None


def test_tails():
    assert placement.edge_tail("T" * 20 + "ACGT" * 20, 20, 100)
    assert not placement.edge_tail("ACGT" * 30, 20, 100)
    assert placement.molecule_tail("CC" + "ACGGA" + "T" * 15 + "ACGT" * 10, 22, 60, "ACGGA")
    assert placement.molecule_tail("ACGT" * 10 + "A" * 15 + "TCCGT", 0, 40, "ACGGA")
    assert not placement.molecule_tail("", 0, 0, None)
    assert placement.genomic_run("ccaaAAtt", 0, 99, "A") == 4


def test_novel_names_agreement_and_groups():
    assert novel.isoform_name(np.array([0, 1, 0, 1])) == "novelIsoform_10"
    assert novel.isoform_name(np.arange(80) == 79) == f"novelIsoform_{2**79}"
    v = np.array([[1, -1, 1], [1, -1, 1], [1, 1, 1], [-1, 0, 1]], dtype=np.int8)
    w = novel.agreement(v)
    assert w[0, 1] == 3 and w[0, 2] == 2 and w[0, 3] == 0 and (w == w.T).all()
    forms = {novel.isoform_name(np.array(b)): np.where(b, 1, -1) for b in ([0, 0, 1], [0, 1, 1], [1, 1, 1])}
    assert set(novel.grouped(forms, "+").values()) == {"novelIsoform_7"}
    assert novel.grouped(forms, "-") == {n: n for n in forms}


def test_discovery_finds_two_isoforms():
    rng = np.random.default_rng(0)
    forms = np.array([[1, 1, -1, -1, 1], [1, -1, 1, 1, -1]], dtype=np.int8)
    reads = forms[rng.integers(0, 2, 60)]
    found, calls = novel.discover(reads, 10, 50)
    assert set(found) == {"novelIsoform_19", "novelIsoform_13"}
    assert all(found[c].tolist() == r.tolist() for c, r in zip(calls, reads, strict=True))
    assert novel.discover(reads[:1], 10, 50) == ({}, [None])


GTF = "\n".join(
    f'c\tx\t{kind}\t{a}\t{b}\t.\t+\t.\tgene_id "{g}"; gene_name "{g}"; transcript_id "{t}";'
    for g, t, kind, a, b in [("A", "", "gene", 1, 500), ("A", "a1", "exon", 1, 100), ("A", "a1", "exon", 201, 300), ("A", "a1", "exon", 401, 500), ("A", "a2", "exon", 1, 100), ("A", "a2", "exon", 401, 500), ("B", "", "gene", 1001, 1200), ("B", "b1", "exon", 1001, 1200)]
)


def test_quantify_counts_each_molecule_once(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF + "\n")
    rows = []
    for i, (pos, cigar, cell, umi) in enumerate([(1, "100M100N100M100N100M", "C1", "U1"), (1, "100M100N100M", "C1", "U1"), (1, "100M300N100M", "C1", "U2"), (1001, "200M", "C2", "U1"), (5001, "50M", "C2", "U9"), (1101, "100M", None, None)]):
        n = sum(int(x) for x in cigar.replace("N", "M").split("M") if x)
        rows.append("\t".join([f"r{i}", "0", "c", str(pos), "60", cigar, "*", "0", "0", "C" * n, "*"] + ([f"CB:Z:{cell}", f"UB:Z:{umi}"] if cell else [])))
    rows.append("\t".join(["u", "4", "*", "0", "0", "*", "*", "0", "0", "C", "*", "CB:Z:C1", "UB:Z:U5"]))
    (tmp_path / "a.sam").write_text("\n".join(rows) + "\n")
    reads = alignments.read_sam_rich(spark, str(tmp_path / "a.sam")).selectExpr("*", "'s' AS sample")
    genes = annotations.read_gtf_annotation(spark, str(tmp_path / "a.gtf"))
    assigned, counts = quantify.quantify(reads, genes)
    assert {(r.qname, r.cell, r.label, r.isoform) for r in assigned.collect()} == {("r0", "C1", "A", "a1"), ("r2", "C1", "A", "a2"), ("r3", "C2", "B", "b1")}
    assert sum(r.n for r in counts.collect()) == 3
