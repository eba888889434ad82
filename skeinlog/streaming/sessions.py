"""Gap sessions and time buckets over a stream of entries, with a watermark for late lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(entries: DataFrame, keys: list[str], at: str = "event_time", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per key: (keys, start, end, n), given out when the watermark has passed them; end is the gap after the last row. A row
    exactly the gap after the one before belongs to its session, as in the batch operator (kernels.gap_sessions)."""
    s = entries.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_buckets(entries: DataFrame, keys: list[str], value: str, at: str = "event_time", width: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Sums per key and time bucket: (keys, start, total, n)."""
    b = entries.withWatermark(at, late).groupBy(*keys, F.window(at, width).alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return b.select(*keys, F.col("w.start").alias("start"), "total", "n")
