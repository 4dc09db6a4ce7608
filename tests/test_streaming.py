from quern.streaming import ingest


def test_stream_adds_each_content_once(spark, tmp_path):
    landing, store, checkpoint = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/at"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (3, "b", "en", "s", 1)], schema).write.parquet(landing)
    ingest.follow(spark, landing, store, checkpoint).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(store).collect()) == [1, 3]
    spark.createDataFrame([(4, "b", "en", "s", 1), (5, None, "en", "s", 0)], schema).write.mode("append").parquet(landing)
    ingest.follow(spark, landing, store, checkpoint).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(store).collect()) == [1, 3, 5]
