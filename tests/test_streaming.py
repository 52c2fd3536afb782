from emberline.streaming.windows import windowed_counts

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    (tmp_path / "in").mkdir()
    table.repartition(3).write.mode("overwrite").parquet(f"file://{tmp_path}/in/t")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in/t")
    q = windowed_counts(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_counts(table).select("start", "event_type", "n")
    got = spark.table("counts").select("start", "event_type", "n")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
