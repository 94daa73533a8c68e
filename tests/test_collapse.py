import random

import pytest

from strandloom.kernels import collapse as c
from strandloom.kernels.models import Model, Tolerance


def read(name, *exons, strand="+", before=None, after=None):
    n = len(exons) - 1
    return c.Read(name, Model(strand, exons), tuple(before or ["0"] * n), tuple(after or ["0"] * n))


def test_genes_are_exon_overlap_components():
    models = [Model("+", ((0, 10), (50, 60))), Model("+", ((20, 30),)), Model("+", ((60, 70),)), Model("+", ((30, 35),)), Model("+", ((90, 99),))]
    assert c.genes_of(models) == [[0, 2], [1, 3], [4]]


def test_votes_and_ties():
    reads = [read("a", (100, 200)), read("b", (100, 205)), read("c", (105, 200)), read("d", (105, 205))]
    assert c.vote(reads, c.CollapseSettings()).exons == [(100, 205)]
    three = [read("a", (100, 200)), read("b", (104, 200)), read("c", (104, 203))]
    assert c.vote(three, c.CollapseSettings()).exons == [(104, 200)]
    assert c.vote(three, c.CollapseSettings(longest=True)).exons == [(100, 203)]
    assert c.vote(three, c.CollapseSettings(capped=False)).exons == [(100, 200)]
    assert c.vote([read(r.name, *r.model.exons, strand="-") for r in three], c.CollapseSettings(capped=False)).exons == [(104, 203)]
    assert c.vote(three, c.CollapseSettings()).start_wobble == [4]


def test_clean_junctions_vote_first():
    dirty = [read(f"d{k}", (0, 100), (200, 300), before=["1I"]) for k in range(3)]
    clean = [read("e", (0, 103), (200, 300))]
    assert c.vote(dirty + clean, c.CollapseSettings()).exons[0] == (0, 100)
    best = c.vote(dirty + clean, c.CollapseSettings(by_errors=True))
    assert best.exons[0] == (0, 103) and best.end_rank[0] == 0 and best.end_tokens[0] == "0>0"
    assert [c.error_rank(*x) for x in (("0", "0"), ("0", "1I"), ("1I", "0"), ("1I", "1I"))] == [0, 1, 2, 3]


@pytest.mark.parametrize("strand", "+-")
def test_capped_and_uncapped_collapse(strand):
    def at(name, *exons):
        return read(name, *(exons if strand == "+" else tuple((1000 - e, 1000 - s) for s, e in reversed(exons))), strand=strand)

    reads = [at("a", (100, 200), (300, 400), (500, 600)), at("b", (102, 200), (300, 400), (500, 601)), at("c", (330, 400), (500, 600)), at("d", (560, 600))]
    capped = c.collapse_gene(reads, c.CollapseSettings())
    assert sorted(m.reads for m in capped) == [["a", "b"], ["c"], ["d"]]
    uncapped = c.collapse_gene(reads, c.CollapseSettings(capped=False))
    assert [m.reads for m in uncapped] == [["a", "b", "c", "d"]]
    assert uncapped[0].exons == ([(100, 200), (300, 400), (500, 600)] if strand == "+" else [(400, 500), (600, 700), (800, 900)])


def test_order_of_reads_does_not_matter():
    rng = random.Random(3)
    reads = [read(f"r{k:02}", (100 + rng.randrange(15), 200), (300, 400 + rng.randrange(15))) for k in range(12)] + [read(f"s{k}", (320 + k, 400)) for k in range(4)]
    for capped in (True, False):
        want = [(m.exons, sorted(m.reads)) for m in c.collapse_gene(reads, c.CollapseSettings(capped=capped, tolerance=Tolerance(3, 3, 3)))]
        for _ in range(5):
            rng.shuffle(reads)
            assert [(m.exons, sorted(m.reads)) for m in c.collapse_gene(reads, c.CollapseSettings(capped=capped, tolerance=Tolerance(3, 3, 3)))] == want
