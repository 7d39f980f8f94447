"""Windowed counts over an event stream, with the same plan for a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str | None = None, value: str | None = None) -> DataFrame:
    """Rows and sums per tumbling window of ``width`` and ``keys``. On a stream, rows later than ``late`` behind the newest are dropped by the watermark;
    on a table ``late`` has no effect and every row counts."""
    df = events.withWatermark(time, late) if late and events.isStreaming else events
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[a for a in ("n", "total") if a in out.columns])
