import pytest

from strandloom.operators import selection as S


def test_subset_genes_names_what_is_missing(spark):
    genes = spark.createDataFrame([("a", "g1", "a_g1"), ("a", "g2", "a_g2"), ("b", "g3", None)], "gene_name string, gene_id string, label string")
    assert {r.gene_id for r in S.subset_genes(genes, ["a_g2", "b"]).collect()} == {"g2", "g3"}
    assert S.subset_genes(genes, ["a"]).count() == 2
    with pytest.raises(ValueError, match="x, y"):
        S.subset_genes(genes, ["a", "x", "y"])


def test_gather_novel_joins_a_known_feature_and_handles_none(spark):
    counts = spark.createDataFrame([("c", "p-novel_1", 2.0), ("c", "q-novel_1", 3.0), ("c", "p", 1.0), ("d", None, 4.0)], "cell string, feature string, n double")
    features = spark.createDataFrame([("p", 0), ("q-novel_1", 1), ("p-novel_1", 2)], "feature string, ord int")
    assert {tuple(r) for r in S.gather_novel(counts, features).collect()} == {("c", "q-novel", 5.0), ("c", "p", 1.0), ("d", None, 4.0)}
    known = counts.where("feature = 'p'")
    assert S.gather_novel(known, known.selectExpr("feature", "1 AS ord")).collect() == known.collect()
    assert S.gather_novel(counts.limit(0), features).count() == 0


def test_with_sequence_needs_one(spark):
    isoforms = spark.createDataFrame([("x",), ("y",)], "id string")
    assert S.with_sequence(isoforms.where("id = 'x'"), spark.createDataFrame([("x", "AC")], "id string, seq string")).first().seq == "AC"
    with pytest.raises(Exception, match="no sequence for y"):
        S.with_sequence(isoforms, spark.createDataFrame([("x", "AC")], "id string, seq string")).collect()


def test_polya_report_and_per_million(spark):
    reads = spark.createDataFrame([("r1", "m", "+", 14, 0.7, "A"), ("r2", "m", "+", 15, 0.75, "A"), ("r3", "m", "-", None, None, None)], "read string, model string, strand string, a_count int, a_share double, polya_seq string")
    assert [(r.read, r.a_percent) for r in S.polya_report(reads).collect()] == [("r2", 75.0)]
    frags = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("t", 0.0), (None, 2.0)], "sample string, expr double")
    assert sorted(S.per_million(frags, "sample", "expr").collect(), key=repr) == sorted([("s", 250000.0), ("s", 750000.0), ("t", 0.0), (None, 1e6)], key=repr)


@pytest.mark.parametrize("width", [2, 3, 7, 1000])
def test_motifs_do_not_depend_on_blocks(spark, width):
    seq = "AAGTCCCCAGTTCTGGGGGACTT"
    genome = spark.createDataFrame([("c", seq), ("e", None)], "chrom string, seq string")
    introns = spark.createDataFrame([("c", 2, 10, "+"), ("c", 12, 21, "-"), ("c", 0, 23, "+")], "chrom string, start long, end long, strand string")
    found = {(r.start, r.end): r.motif for r in S.intron_motifs(introns, genome, width).collect()}
    complement = str.maketrans("ACGT", "TGCA")
    assert found == {(2, 10): "GTAG", (12, 21): (seq[12:14] + seq[19:21])[::-1].translate(complement), (0, 23): "AATT"}


@pytest.mark.parametrize(("row", "error"), [(("c", 4, 5, "+"), "fewer than two"), (("c", 1, 90, "+"), "outside"), (("z", 0, 4, "+"), "outside")])
def test_bad_introns_are_errors(spark, row, error):
    genome = spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string")
    with pytest.raises(Exception, match=error):
        S.intron_motifs(spark.createDataFrame([row], "chrom string, start long, end long, strand string"), genome).collect()


def test_transfrag_checks_mark_every_rule(spark):
    genome = spark.createDataFrame([("c", "AAGTCCCCAGTTACGGGGGGTTTT")], "chrom string, seq string")
    schema = "id string, chrom string, strand string, exons array<struct<start: long, end: long>>, expr double"
    frags = spark.createDataFrame([("good", "c", "+", [(0, 2), (10, 24)], 5.0), ("bad", "c", "+", [(0, 2), (10, 12), (20, 24)], 0.1), ("one", "c", "+", [(0, 20)], 5.0)], schema)
    rows = {r.id: (r.too_short, r.too_weak, r.bad_introns, r.keep) for r in S.transfrag_checks(frags, least_length=10, least_expr=1.0, genome=genome).collect()}
    assert rows == {"good": (False, False, 0, True), "bad": (True, True, 1, False), "one": (False, False, 0, True)}
    extra = S.transfrag_checks(frags, least_length=1, least_expr=0.0, genome=genome, motifs=["acgg"])
    assert {r.id: (r.bad_introns, r.keep) for r in extra.collect()} == {"good": (0, True), "bad": (0, True), "one": (0, True)}
    assert S.transfrag_checks(frags, least_length=10, least_expr=0.0).where("keep").count() == 2
