"""The sliding windows on a stream. Late events are taken up to the watermark; state beyond it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, ts: str = "ts", user: str = "user_id", value: str = "value", window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, window_end, user, comment_count, mean_value; batch and streaming alike. ts must be a timestamp."""
    w = F.window(ts, window, slide)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), user).agg(F.count(F.lit(1)).alias("comment_count"), F.avg(value).alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), user, "comment_count", "mean_value")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """session_start, session_end, user, n: visits that are at least a gap apart."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), user, "n")
