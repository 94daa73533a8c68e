import pytest

from strandloom.kernels.ends import CombineSettings, Isoform, annotated, combine_chain, end_groups, gene_name, most_common, representative, set_aside_name
from strandloom.operators import combine


def iso(start, end, name="x_g", usage=1.0, counts=1, sample="s"):
    return Isoform(start, end, sample, name, usage, counts)


def test_representatives_and_groups():
    assert representative([iso(0, 10, "a", 0.5), iso(0, 20, "b", 0.5), iso(0, 30, "c", 0.2)]).name == "b"
    with pytest.raises(ValueError, match="usage is 0"):
        representative([iso(0, 1, usage=0.0)])
    groups = end_groups([iso(1000, 2000, "a"), iso(1150, 1500, "b"), iso(1300, 1650, "c"), iso(1600, 1700, "d")], 200)
    assert [[m.name for m in own] for _, own in groups] == [["a", "b", "c"], ["d"]]


def test_names():
    assert most_common(["b", "a", "a", "b"]) == "b"
    assert gene_name([iso(0, 1, "x_chr1:10"), iso(0, 1, "y_ENSG01")]) == "ENSG01"
    assert gene_name([iso(0, 1, "x_chr1:10"), iso(0, 1, "y_z")]) == "chr1:10"
    assert gene_name([iso(0, 1, "x_b"), iso(0, 1, "y_b")]) == "b"
    assert set_aside_name([iso(0, 1, "x_b"), iso(0, 1, "y_ENSG7")]) == "lowexpiso_ENSG7"
    assert annotated("ENST0001_ENSG0001") and not annotated("ENST0001") and not annotated("x_ENSG1")


def test_chain_rules():
    weak, strong = iso(1000, 5000, "a_g", 0.05, 1), iso(3000, 9000, "b_g", 0.5, 7)
    both = combine_chain([weak, strong], CombineSettings(), fusion=False, single=False)
    assert [(k, tail, keep) for k, tail, keep, _, _ in both.rows] == [(1, "lowexpiso_g", False), (2, "-2_g", True)]
    assert not combine_chain([weak], CombineSettings(), fusion=False, single=False).kept
    assert combine_chain([weak], CombineSettings(rule="none"), fusion=False, single=False).rows[0][2]
    assert combine_chain([weak, strong], CombineSettings(rule="7"), fusion=False, single=False).rows[1][2]


def test_combine_frame(spark):
    schema = "sample string, ord long, chrom string, strand string, name string, start long, end long, exons array<struct<start:bigint,end:bigint>>"
    bed = spark.createDataFrame([
        ("s1", 1, "c", "+", "i1_g1", 1000, 2000, [(1000, 1200), (1500, 2000)]),
        ("s1", 2, "c", "+", "ENST1_ENSG1", 5000, 5900, [(5000, 5100), (5200, 5900)]),
        ("s2", 11, "c", "+", "j1_g1", 1050, 2100, [(1050, 1200), (1500, 2100)]),
        ("s2", 12, "c", "-", "k1_g2", 25000, 26000, [(25000, 26000)]),
    ], schema)
    fusion = spark.createDataFrame([("s2", 13, "c", "+", "fusiongene1_f_gA", 100, 300, [(100, 150), (200, 300)]), ("s2", 14, "d", "-", "fusiongene2_f_gA", 700, 900, [(700, 900)])], schema)
    chains = combine.isoform_chains(bed).unionByName(combine.fusion_chains(fusion))
    done = combine.combine(combine.with_usage(chains, None, None))
    rows = {r.name: [(e.start, e.end) for e in r.exons] for r in done.bed.collect()}
    assert rows == {
        "isoform1-1_g1": [(1050, 1200), (1500, 2100)],
        "2-1_ENST1_ENSG1": [(5000, 5100), (5200, 5900)],
        "isoform3-1_g2": [(25000, 26000)],
        "fusiongene1_isoform4-1_gA": [(100, 150), (200, 300)],
        "fusiongene2_isoform4-1_gA": [(700, 900)],
    }
    lists = {r.name: r.members for r in combine.member_lists(done).collect()}
    assert lists["isoform1-1_g1"] == ["s2..j1_g1", "s1..i1_g1"]
    table = {r.name: (r.s1, r.s2) for r in combine.support_table(done, ["s1", "s2"]).collect()}
    assert table == {"isoform1-1_g1": (1, 1), "2-1_ENST1_ENSG1": (1, 0), "isoform3-1_g2": (0, 1), "isoform4-1_gA": (0, 1)}


def test_usage_needs_every_isoform(spark):
    from pyspark.errors import PySparkException

    chains = spark.createDataFrame([("s", 1, "i_g", "i_g"), ("s", 2, "j_g", "j_g")], "sample string, ord long, name string, raw string")
    maps = spark.createDataFrame([("s", "i_g", 3)], "sample string, isoform string, n long"), spark.createDataFrame([("s", "g", 12)], "sample string, gene string, n long")
    assert combine.with_usage(chains.where("ord = 1"), *maps).first().usage == 0.25
    with pytest.raises(PySparkException, match="no reads for j_g"):
        combine.with_usage(chains, *maps).collect()
