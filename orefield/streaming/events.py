"""Windows over events; the same code takes batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_watermark(events: DataFrame, late: str | None) -> DataFrame:
    """Watermarks need instants; timestamps without zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) for each window; ``late`` sets a watermark for streams."""
    rows = _with_watermark(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n) for each stretch of events with pauses under ``gap``."""
    rows = _with_watermark(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
