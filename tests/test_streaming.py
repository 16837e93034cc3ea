from sparrowloom.streaming import logs

DATA = "/root/testdata/sf0.001/responses.parquet"


def test_drained_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = logs.arriving(spark, str(tmp_path / "in"), batch.schema)
    live = logs.hourly(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    live.awaitTermination()
    key = lambda df: sorted((r.hour, r.n, r.errors) for r in df.collect())
    assert key(spark.table("hourly")) == key(logs.hourly(batch))
    for _ in range(2):  # the second run finds nothing new
        logs.drain(stream.select("id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
