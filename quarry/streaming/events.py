"""Structured Streaming over event tables: an extension, for tables that keep arriving.

The same functions take batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without is read in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, width: str, keys: list[str], *, ts: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Count and sum by tumbling event-time window and keys; on a stream, rows later than ``late`` are left out and windows close."""
    rows = _timed(events, ts).withWatermark(ts, late) if events.isStreaming else _timed(events, ts)
    g = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def first_seen(events: DataFrame, key: str, *, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key; on a stream, within the watermark, so that state is bounded."""
    if events.isStreaming:
        return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
