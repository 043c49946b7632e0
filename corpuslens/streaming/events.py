"""Streams of events: daily counts with late data, sessions, and running counts per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def daily_sentiment(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, n_positive, n_negative, total) by day of ts; value above 0.6 of its scale of 100 counts as
    positive, below 0.4 as negative. On a stream, rows later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") >= 60).alias("n_positive"), F.count_if(F.col("value") < 40).alias("n_negative")
    )
    return rows.select(F.col("w.start").alias("day"), "event_type", "n", "n_positive", "n_negative")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): events of a user with less than the gap between them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def running_counts(events: DataFrame) -> DataFrame:
    """(user_id, n): the number of a user's events so far, kept as state across batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, parts, state: GroupState):
        import pandas as pd

        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long", "n long", "update", GroupStateTimeout.NoTimeout)
