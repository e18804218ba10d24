"""Popularity over time and sessions of events; each works on a batch or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an event may be in a stream, and the gap that ends a session.
LATE, GAP = "1 hour", "30 minutes"


def _marked(events: DataFrame, time: str) -> DataFrame:
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATE)


def popularity_by_window(events: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows and sum of values of each key in each window."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = _marked(events, time).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = GAP) -> DataFrame:
    """Sessions of each user: start, end (last event plus the gap) and rows."""
    out = _marked(events, time).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def decayed_popularity(df: DataFrame, item: str, time: str, weight: str, at, half_life_days: float = 30.0) -> DataFrame:
    """(item, score): weights that halve with each half-life before ``at`` (a column)."""
    age = F.timestamp_diff("MICROSECOND", F.col(time), at) / F.lit(86_400e6)
    return df.groupBy(item).agg(F.sum(F.col(weight) * F.pow(F.lit(0.5), age / half_life_days)).alias("score"))


def transitions(events: DataFrame, user: str = "user_id", time: str = "ts", item: str = "event_type", tie: str = "event_id") -> DataFrame:
    """(item, next_item, n, share): what follows what in each user's order of time."""
    from pyspark.sql import Window

    following = F.lead(item).over(Window.partitionBy(user).orderBy(time, tie))
    pairs = events.withColumn("next_item", following).where(F.col("next_item").isNotNull())
    counts = pairs.groupBy(item, "next_item").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(item)))


def keep_popularity(stream: DataFrame, path: str, checkpoint: str, key: str = "event_type", value: str = "value"):
    """Starts a query that adds each batch's counts and sums to a Parquet folder; returns the query.

    A batch writes the folder of its own number, so a batch that runs again replaces its rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_popularity(spark, path: str, key: str = "event_type") -> DataFrame:
    """The sums over all batches."""
    return spark.read.parquet(path).groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
