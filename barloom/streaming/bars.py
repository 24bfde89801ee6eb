"""Bars from a stream of ticks: windows with a watermark, as a stream or as a batch with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_bars(ticks: DataFrame, symbol: str, at: str, price: str, size: str = "6 hours") -> DataFrame:
    """One bar for each symbol and window. Ticks of a window are combined as they come: its state is one row."""
    grouped = ticks.groupBy(F.window(at, size), F.col(symbol).alias("symbol"))
    out = grouped.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
    return out.select("symbol", F.col("window.start").alias("dt"), "open", "high", "low", "close", "volume")


def batch_bars(events: DataFrame, size: str = "6 hours") -> DataFrame:
    return window_bars(events, "event_type", "ts", "value", size)


def stream_bars(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """The same over a stream: a window comes out once the watermark has passed its end; later ticks are dropped."""
    return window_bars(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), "event_type", "ts", "value", size)


def write_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Bars of a stream as a table, each exactly once; takes what is there and stops."""
    return bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
