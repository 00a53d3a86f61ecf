"""Session capture from an event stream, and stability waits, with event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def captured_sessions(events: DataFrame, key: str = "user_id", idle: str = "5 minutes", late: str = "10 minutes", least_seconds: int = 30) -> DataFrame:
    """key, start, end, events, value, seconds: sessions closed after an idle gap; shorter ones are dropped.

    Works on streams (append mode: a session comes out when the watermark has passed its end) and on batches.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(key, F.session_window("ts", idle)).agg(F.count("*").alias("events"), F.sum("value").alias("value"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    return grouped.select(key, "start", "end", "events", "value", seconds.alias("seconds")).where(F.col("seconds") >= least_seconds)


def quiet_groups(events: DataFrame, key: str, quiet: str, late: str = "1 minute") -> DataFrame:
    """key, first, last, n: bursts that end after a quiet time (folder creation, copies still being written)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(key, F.session_window("ts", quiet)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, by: list[str | Column] = (), late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "value")
