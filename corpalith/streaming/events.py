"""Streams of events: windows with late data, deduplicated enqueueing, latest readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; on a stream, rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    over = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(over.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, stop, n) of runs of events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def enqueue(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """One request for each (user_id, event_type) while one is waiting."""
    if requests.isStreaming:
        return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return requests.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def latest(events: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """(user_id, event_type, value, stale): the last reading of each key, stale beyond its time to live."""
    last = events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", "x.value", (F.unix_timestamp(as_of) - F.unix_timestamp("x.ts") > ttl_seconds).alias("stale"))


def backoff(attempt: Column, most: int = 3) -> Column:
    """Seconds until the next try, doubling from 5 up to 300; null after the last attempt."""
    return F.when(attempt < most, F.least(F.lit(300), 5 * F.pow(F.lit(2), attempt - 1))).cast("long")
