from pathlib import Path

import pytest

import corpus_pipeline

SF = Path("/root/testdata/sf0.001")


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmarks", "packing"]


@pytest.mark.skipif(not SF.exists(), reason="test tables are absent")
def test_stages_keep_columns_and_packing_covers_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(SF))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).select("doc_id", "length", "doc_tokens").toPandas()
    whole = pieces.groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert (whole.length == whole.doc_tokens).all()
    assert set(whole.index) == {r.doc_id for r in docs.select("doc_id").collect()}
