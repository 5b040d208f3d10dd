from pyspark.sql import functions as F

from fathomline.streaming import progress


def test_latest_state_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = progress.stream_events(spark, str(tmp_path / "in"), events)
    progress.stream_latest(stream, "user_id", "event_id", ["event_type", "value"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = progress.latest(events, "user_id", "event_id", ["event_type", "value"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_bursts_stream_closes_all_but_the_last(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.stream_bursts(progress.stream_events(spark, str(tmp_path / "in"), events), "user_id", "ts", "1 hour", "0 seconds")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = progress.debounced(events, "user_id", "ts", "event_id", 3600)
    last = batch.agg(F.max("last")).first()[0]
    assert got.count() <= batch.count() and got.join(batch, ["user_id", "events"], "left_semi").count() == got.count() and last is not None
