"""Streams give what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.streaming import events as ev


def _events(spark, path):
    rows = [(n, f"2024-01-0{1 + n // 40} 0{n % 10}:{n % 60:02d}:00", n % 5, "view" if n % 3 else "click", float(n)) for n in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        df.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_kept_popularity(spark, tmp_path):
    batch = _events(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ev.keep_popularity(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    expected = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, ev.kept_popularity(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, expected.collect()))


def test_windows_on_a_stream(spark, tmp_path):
    batch = _events(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = ev.popularity_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, ev.popularity_by_window(batch).collect()))
    assert ev.sessions(batch).agg(F.sum("n")).first()[0] == 120
