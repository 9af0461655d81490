"""Bars from ticks: the same aggregation over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, ts: str, key: str, value: str, width: str, order: str, late: str | None = None) -> DataFrame:
    """Open, high, low, close, total and count by tumbling window and key. With `late`, a stream's windows close that long
    after their end, so unfinished bars are not emitted. `order` decides among ticks of equal time."""
    source = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else ticks
    at = F.struct(ts, order)
    return source.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("market")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("total"), F.count("*").alias("n_ticks")
    ).select(F.col("w.start").alias("ts"), "market", "open", "high", "low", "close", "total", "n_ticks")
