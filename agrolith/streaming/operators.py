"""Streaming forms of the batch operators: late revisions, part days, sliding sums, silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """Event time as a timestamp, with the watermark within which values may still be revised."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def full_days(stream: DataFrame, least: int) -> DataFrame:
    """Day totals by key, withheld while a day has fewer than ``least`` records."""
    day = timed(stream).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return day.where(F.col("n") >= least).select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def sliding_sums(stream: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    w = timed(stream).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.sum("value").alias("total"))
    return w.select(F.col("w.start").cast("date").alias("since"), F.col("w.end").cast("date").alias("until"), "event_type", "total")


def sessions(stream: DataFrame, gap: str, late: str = "10 days") -> DataFrame:
    """Runs of a user's events without a silence of ``gap`` or more; in append mode each is told once, when no event can join it any more."""
    s = timed(stream, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").alias("since"), "n", "total")


def edges(stream: DataFrame) -> DataFrame:
    """The latest event time of each layer."""
    return timed(stream).groupBy("event_type").agg(F.max("ts").alias("edge"))


def persisted(index: DataFrame, keys: list[str], day: str, value: str, most: int) -> DataFrame:
    """A late index as each day may use it: the last value at most ``most`` days old and from an earlier day. Rows (keys, day, value)."""
    ahead = index.select(*keys, day, value, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("__age"))
    usable = ahead.groupBy(*keys, F.date_add(day, F.col("__age")).alias("day"))
    return usable.agg(F.max_by(value, day).alias(value))
