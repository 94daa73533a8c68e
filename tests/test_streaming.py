import pytest

from strandloom.streaming.loci import advance, locus_stream


def test_advance():
    open_, number, closed = advance(None, 0, iter([(1, 10), (5, 12), (12, 20), (30, 31)]))
    assert (open_, number, closed) == ((30, 31, 1), 1, [(1, 1, 20, 3)])
    assert advance(open_, number, iter([(None, None)])) == (None, 2, [(2, 30, 31, 1)])
    with pytest.raises(ValueError, match="record at 3"):
        advance((5, 9, 1), 0, iter([(3, 4)]))


def test_stream_over_two_files(spark, tmp_path):
    schema = "scaffold string, start long, end long, ord long"
    for k, rows in enumerate([[("a", 1, 10, 1), ("a", 8, 15, 2), ("b", 5, 9, 3)], [("a", 14, 20, 4), ("a", 40, 50, 5), ("b", None, None, 6), ("a", None, None, 7)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    query = locus_stream(stream).writeStream.format("memory").queryName("loci").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("loci").collect()} == {("a", 1, 1, 20, 3), ("a", 2, 40, 50, 1), ("b", 1, 5, 9, 1)}
