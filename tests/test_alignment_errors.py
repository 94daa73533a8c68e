import pytest

from strandloom.kernels import alignment_errors as ae
from strandloom.kernels.models import Model, Tolerance, same_capped, same_uncapped

GENOME = "ACGTACGTAC" + "GTTTTTTTAG" + "CCGGTTAACC"


def test_walk_counts_and_events():
    seq = "NN" + "ACGTTCG" + "GG" + "AC" + "CAGG"
    out = ae.walk(1, [(2, "S"), (7, "M"), (2, "I"), (1, "D"), (2, "M"), (10, "N"), (4, "M"), (3, "H")], seq, GENOME, 10)
    assert out.counts == {"H": 3, "S": 2, "I": 2, "D": 1, "X": 2}
    assert out.events == [(-2, "S", "NN"), (4, "M", "T"), (7, "I", "GG"), (7, "D", "1"), (21, "M", "A"), (21, "H", "NNN")]
    assert out.before == ["6.T.A_2I_1D_2M"]
    assert out.after == ["1.A.C_3H"]


def test_walk_errors():
    with pytest.raises(ValueError, match="edge"):
        ae.walk(1, [(10, "N"), (1, "M")], "A", GENOME, 10)
    with pytest.raises(ValueError, match="unknown base"):
        ae.walk(1, [(1, "M")], "?", GENOME, 10)
    with pytest.raises(ValueError, match="unknown here"):
        ae.walk(1, [(1, "P")], "A", GENOME, 10)


def test_codes_overlap():
    assert ae.mismatches("ACGTN", "acgta").tolist() == []
    assert ae.mismatches("KMYR", "GAAC").tolist() == [0, 1]


def test_clean_sides_are_zero():
    out = ae.walk(1, [(10, "M"), (10, "N"), (10, "M")], GENOME[:10] + GENOME[20:], GENOME, 5)
    assert (out.before, out.after) == (["0"], ["0"])


def test_pictures_and_density():
    assert ae.side_picture("2.A.C_3M", 6, "_", before=False) == "__X___"
    assert ae.side_picture("1I_2M", 5, "_", before=True) == "__I__"
    assert ae.side_picture("0", 4, "_", before=True) == "____"
    assert ae.side_counts("2S_6.T.A_2I_1D_2M") == (2, 1, 1, 2, 0)
    found = ae.density(["2I", "0"], ["0", "1.A.C"], "-", 4, 1)
    assert (found["bad_sides"], found["junctions"], found["totals"]) == (1, "2", "2>0,0>1")
    assert found["profiles"] == "2,0,0,0,0>0,0,0,0,0;0,0,0,0,0>0,0,1,0,0"
    assert ae.density([], [], "+", 4, 1)["totals"] == "na"
    with pytest.raises(ValueError, match="bad error token"):
        ae.token_error("3Q")


def test_polya_window():
    assert ae.polya_window("+", "CCCC" + "A" * 30, 0, 4) == ("A" * 20, 20, 1.0)
    assert ae.polya_window("-", "TTTTG" + "C" * 10, 5, 15) == ("CAAAA", 4, 0.8)
    assert ae.polya_window("+", "ACG", 0, 3) == ("", 0, 0.0)


@pytest.mark.parametrize("strand", "+-")
def test_model_comparison(strand):
    def model(*exons):
        return Model(strand, exons if strand == "+" else tuple((1000 - e, 1000 - s) for s, e in reversed(exons)))

    t = Tolerance()
    full = model((100, 200), (300, 400), (500, 600))
    assert same_capped(full, model((105, 200), (300, 395), (500, 610)), t)
    assert not same_capped(full, model((80, 200), (300, 400), (500, 600)), t)
    assert not same_capped(full, model((300, 400), (500, 600)), t)
    assert same_uncapped(full, model((320, 400), (500, 600)), t)
    assert not same_uncapped(full, model((250, 400), (500, 600)), t)
    assert same_uncapped(full, model((20, 200), (300, 400), (500, 600)), t)
    assert not same_uncapped(full, model((320, 400), (500, 640)), t)
    assert not same_uncapped(full, model((600, 700)), t)
