"""Event-time windows over a stream of events: tumbling, sliding and session windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _windowed(events: DataFrame, window: Column, lateness: str, keys: list[str]) -> DataFrame:
    """Sums of ``(ts, value, k)`` by window and keys; partial sums are formed before the shuffle, so a frequent key is a few rows."""
    return events.withWatermark("ts", lateness).groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum("k").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def tumbling(events: DataFrame, size: str, lateness: str, keys: list[str]) -> DataFrame:
    """One row a key and window of ``size``, final once the watermark has passed the window's end."""
    return _windowed(events, F.window("ts", size), lateness, keys).select(*keys, F.col("w.start").alias("opened"), "events", "total", "least", "most")


def sliding(events: DataFrame, size: str, step: str, lateness: str, keys: list[str]) -> DataFrame:
    """The same with a window of ``size`` beginning every ``step``; an event counts in each window it lies in."""
    return _windowed(events, F.window("ts", size, step), lateness, keys).select(*keys, F.col("w.start").alias("opened"), "events", "total", "least", "most")


def sessions(events: DataFrame, gap: str, lateness: str, keys: list[str]) -> DataFrame:
    """Runs of a key's events that follow one another within ``gap``; ``closed`` is the last event's time and the gap."""
    return _windowed(events, F.session_window("ts", gap), lateness, keys).select(
        *keys, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "events", "total", "least", "most")


def drain(frame: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append final windows to a folder until what is there now is read; the file sink's log keeps each batch once."""
    return (frame.writeStream.outputMode("append").format("parquet").option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
