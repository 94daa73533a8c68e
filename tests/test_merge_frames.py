import pytest

from strandloom.operators import merge
from strandloom.sinks import results

SCHEMA = "chrom string, start long, end long, name string, strand string, exons array<struct<start:bigint,end:bigint>>, thick_start long, thick_end long"


def test_merge_two_sources(spark):
    one = spark.createDataFrame([("c", 100, 400, "g;t1", "+", [(100, 200), (300, 400)], 100, 400), ("c", 900, 950, "h;t2", "-", [(900, 950)], 900, 950)], SCHEMA)
    two = spark.createDataFrame([("c", 105, 402, "k;u1", "+", [(105, 200), (300, 402)], 105, 402), ("c", 320, 400, "k;u2", "+", [(320, 400)], 320, 400)], SCHEMA)
    models = merge.source_models(one, "a", capped=True, priority=(1, 1, 1)).unionByName(merge.source_models(two, "b", capped=False, priority=(2, 1, 1)))
    merged = merge.merge(models)
    rows = {r.model_id: r for r in merged.collect()}
    assert {k: r.members for k, r in rows.items()} == {"G1.1": ["a_t1", "b_u1", "b_u2"], "G2.1": ["a_t2"]}
    assert (rows["G1.1"].starts, rows["G1.1"].ends) == ([100, 300], [200, 400])
    report = {r.gene_id: (r.members, r.models, r.sources, r.source_genes) for r in merge.gene_report(merged, models).collect()}
    assert report == {"G1": (3, 1, "a,b", "a_g,b_k"), "G2": (1, 1, "a", "a_h")}


def lines_of(spark, path, name):
    from strandloom.sinks.files import read_file

    return [r.line for r in sorted(read_file(spark, path, name).collect(), key=lambda r: (r.part, r.ord))]


def test_merge_files_coding_spans_and_missing_sources(spark, tmp_path):
    one = spark.createDataFrame([("c", 100, 400, "G7;G7.1", "+", [(100, 200), (300, 400)], 120, 380), ("c", 900, 950, "G8;G8.1", "-", [(900, 950)], 0, 0)], SCHEMA)
    two = spark.createDataFrame([("c", 105, 402, "K;K.1", "+", [(105, 200), (300, 402)], 150, 350), ("c", 105, 402, "K;K.2", "+", [(105, 200), (300, 402)], 155, 355)], SCHEMA)
    models = merge.source_models(one, "a", capped=True, priority=(1, 1, 1)).unionByName(merge.source_models(two, "b", capped=True, priority=(2, 1, 1)))
    merged = merge.merge(models).cache()
    spans = {r.model_id: r for r in merge.coding_spans(merged, models, coding=["b"], naming=["a"]).collect()}
    assert (spans["G1.1"].thick_start, spans["G1.1"].thick_end, spans["G1.1"].label, spans["G1.1"].colour) == (155, 355, "G1;G1.1;G7;G7.1", "200,0,255")
    assert (spans["G2.1"].thick_start, spans["G2.1"].thick_end, spans["G2.1"].label, spans["G2.1"].colour) == (900, 950, "G2;G2.1;G8;G8.1", "255,0,0")
    results.write_merge(merged, models, str(tmp_path / "out"), "m", coding=["a"])
    assert lines_of(spark, str(tmp_path / "out"), "m.bed") == ["c\t100\t402\tG1;G1.1\t40\t+\t120\t380\t200,0,255\t2\t100,102\t0,200", "c\t900\t950\tG2;G2.1\t40\t-\t900\t950\t255,0,0\t1\t50\t0"]
    assert lines_of(spark, str(tmp_path / "out"), "m_merge.txt")[:2] == ["c\t100\t400\tG1.1;a_G7.1\t40\t+\t100\t400\t255,0,0\t2\t100,100\t0,200", "c\t105\t402\tG1.1;b_K.1\t40\t+\t105\t402\t255,0,0\t2\t95,102\t0,195"]
    assert lines_of(spark, str(tmp_path / "out"), "m_gene_report.txt") == [results.GENES, "G1\t3\t1\ta,b\tc\t100\t402\ta_G7,b_K\ta:1,b:1", "G2\t1\t1\ta\tc\t900\t950\ta_G8\ta:1"]
    report = lines_of(spark, str(tmp_path / "out"), "m_trans_report.txt")
    assert report[0] == results.TRANSCRIPTS and report[1].startswith("G1.1\t3\ta,b\t") and report[1].endswith("\ta_G7.1,b_K.1,b_K.2")
    with pytest.raises(Exception, match="no source model for member"):
        merge.gene_report(merged, models.where("member <> 'b_K.2'")).collect()


def test_matrix_and_sample_files(spark, tmp_path):
    rows = [("c1", "g1", "t1", 2), ("c1", "g1", "t2", 1), ("c2", "g2", "t,3", 5), ("c1", "g1", "t1", 1)]
    results.write_sample(spark.createDataFrame(rows, "cell string, label string, isoform string, n long"), 0, str(tmp_path / "s"))
    assert lines_of(spark, str(tmp_path / "s"), "gene_counts.csv") == ["cell,g1,g2", "c1:sample0,4,0", "c2:sample0,0,5"]
    assert lines_of(spark, str(tmp_path / "s"), "transcript_counts.csv") == ['cell,g1_t1,g1_t2,"g2_t,3"', "c1:sample0,3,1,0", "c2:sample0,0,0,5"]
    assert lines_of(spark, str(tmp_path / "s"), "gene_transcript.tsv") == ["genes\ttranscripts", "g1\tg1_t1", "g1\tg1_t2", "g2\tg2_t,3"]


def test_combine_files(spark, tmp_path):
    from strandloom.operators import combine

    schema = "sample string, ord long, chrom string, strand string, name string, start long, end long, exons array<struct<start:bigint,end:bigint>>"
    bed = spark.createDataFrame([("s1", 1, "c", "+", "i1_g1", 1000, 2000, [(1000, 1200), (1500, 2000)]), ("s2", 11, "c", "+", "j1_g1", 1050, 2100, [(1050, 1200), (1500, 2100)])], schema)
    done = combine.combine(combine.with_usage(combine.isoform_chains(bed), None, None))
    named = done.bed.select("rep_sample", "rep_name").distinct().selectExpr("*", "'ACGT' AS seq")
    results.write_combine(done, ["s1", "s2"], str(tmp_path / "out"), "x", named)
    assert lines_of(spark, str(tmp_path / "out"), "x.counts.tsv") == ["ids\ts1\ts2", "isoform1-1_g1\t1\t1"]
    assert lines_of(spark, str(tmp_path / "out"), "x.isoform.map.txt") == ["isoform1-1_g1\ts2..j1_g1\ts1..i1_g1"]
    assert lines_of(spark, str(tmp_path / "out"), "x.fa") == [">isoform1-1_g1", "ACGT"]
    assert lines_of(spark, str(tmp_path / "out"), "x.bed") == ["c\t1050\t2100\tisoform1-1_g1\t1000\t+\t1050\t2100\t0\t2\t150,600,\t0,450,"]
