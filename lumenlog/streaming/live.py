"""Streams over the logs: tailing, settling, hub windows, counters, pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New JSONL files of a folder as they come. Files are immutable here: a rewritten log is a new file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def settled(rows: DataFrame, now: object, minutes: int = 10) -> DataFrame:
    """Rows old enough to be read: younger ones wait for a later pass."""
    return rows.where(F.col("ts") <= F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))


def hub_windows(told: DataFrame, late: str = "10 minutes", window: str = "14 days", slide: str = "1 day") -> DataFrame:
    """Distinct sessions that were told each id, over sliding windows of event time."""
    return told.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "id").agg(F.size(F.collect_set("session")).alias("sessions"))


def live_counters(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Day counters as a stream: late lines within the watermark still count."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return lines.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("fired"), n(F.col("event") == "prompt").alias("prompts"), n(F.col("event") == "stop").alias("stops"), n(F.col("level") == "error").alias("errors"))


def publish(lines: DataFrame, sink, checkpoint: str, once: bool = True):
    """Hand each batch to sink(batch, number): the push side of a live view."""
    w = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
