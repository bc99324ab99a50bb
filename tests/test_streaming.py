from tessera.streaming import ingest


def test_stream_of_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a\n" * 100), (2, "b"), (1, "a\n" * 100)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in/one"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in/*"))
    q = ingest.write_chunks(docs, str(tmp_path / "out"), str(tmp_path / "cp"), 64).trigger(availableNow=True).start()
    q.awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.filter("doc_id = 2").count() == 1 and found.filter("doc_id = 1").count() == 4


def test_a_later_batch_replaces_a_document(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [[(1, "a\n" * 100, 1), (2, "b", 1), (3, "c", 1)], [(1, "new", 2), (1, "old", 1), (3, " ", 2)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "doc_id long, text string, v int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        docs = spark.readStream.schema("doc_id long, text string, v int").parquet(str(tmp_path / "in/*"))
        ingest.write_chunks(docs, str(tmp_path / "out"), str(tmp_path / "cp"), 64, "v").trigger(availableNow=True).start().awaitTermination(60)
    got = {(r["doc_id"], r["text"]) for r in ingest.current(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "new"), (2, "b")}
