import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns whose names clash."""

    def make(rows, schema="doc_id long, text string, lang string"):
        padded = [(*r, None) if len(r) == 2 else r for r in rows]
        frame = spark.createDataFrame(padded, schema)
        return frame.selectExpr("*", "'x' AS node", "1 AS n_tokens", "'y' AS _gone")

    return make
