"""Time: intervals, sliding windows, and how many posts a comment's author could have seen."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Whole days from start to end, both included."""

    label: str
    start: date
    end: date

    @property
    def stop(self) -> date:
        return self.end + timedelta(days=1)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def add_months(day: date, months: int) -> date:
    """The first of the month that lies so many months on."""
    at = day.year * 12 + day.month - 1 + months
    return date(at // 12, at % 12 + 1, 1)


def month_windows(first: date, last: date, months: int = 4, slide: int = 1) -> list[Interval]:
    """Calendar windows w01, w02, ...; the last one ends with the month of `last`."""
    out, start = [], date(first.year, first.month, 1)
    while (stop := add_months(start, months)) <= add_months(last, 1):
        out.append(Interval(f"w{len(out) + 1:02d}", start, stop - timedelta(days=1)))
        start = add_months(start, slide)
    return out


def day_windows(first: date, last: date, days: int = 7, slide: int = 1) -> list[Interval]:
    out, start = [], first
    while start + timedelta(days=days - 1) <= last:
        out.append(Interval(f"w{len(out) + 1:02d}", start, start + timedelta(days=days - 1)))
        start += timedelta(days=slide)
    return out


def interval_table(spark: SparkSession, intervals: Sequence[Interval], prefix: str = "window") -> DataFrame:
    rows = [(w.label, i + 1, w.start, w.end, w.days) for i, w in enumerate(intervals)]
    return spark.createDataFrame(rows, f"{prefix}_id string, {prefix}_index int, {prefix}_start date, {prefix}_end date, {prefix}_total_days int")


def in_range(ts: Column, first: date, last: date) -> Column:
    """Half open: from first to the end of last."""
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))


def assign_interval(ts: Column, intervals: Sequence[Interval]) -> Column:
    """Label of the interval, null in a gap. A chain of conditions: no join for a handful of eras."""
    out = F.lit(None).cast("string")
    for w in reversed(intervals):
        out = F.when(in_range(ts, w.start, w.end), F.lit(w.label)).otherwise(out)
    return out


def explode_windows(df: DataFrame, ts: str, intervals: Sequence[Interval], prefix: str = "window") -> DataFrame:
    """A row for each window that covers ts. Windows are looked up by day in a small calendar, so each row meets only its own."""
    spark = df.sparkSession
    calendar = [(w.start + timedelta(days=d), w.label, i + 1) for i, w in enumerate(intervals) for d in range(w.days)]
    table = F.broadcast(spark.createDataFrame(calendar, f"tm_day date, {prefix}_id string, {prefix}_index int"))  # days x overlap rows, set by the specification
    return df.withColumn("tm_on", F.col(ts).cast("date")).join(table, F.col("tm_on") == F.col("tm_day")).drop("tm_on", "tm_day")


def posts_seen(comments: DataFrame, posts: DataFrame, ts: str = "ts", by: Sequence[str] = (), out: str = "posts_seen", bucket: str = "DAY") -> DataFrame:
    """comments with how many posts of the same `by` have a time up to theirs, equal times included.

    A running sum over posts and comments together. One window over a whole era would be one task, so
    time is cut into buckets: the posts before a bucket come from a running sum of the buckets' counts,
    and rows are ordered within their bucket alone. No inequality join.
    """
    kept = comments.columns
    cut = F.date_trunc(bucket, F.col(ts)).alias("tm_bucket")
    left = comments.select(*[F.col(b) for b in by], F.col(ts).alias("tm_ts"), F.lit(1).alias("tm_tag"), F.struct(*kept).alias("tm_row"), cut)
    right = posts.select(*[F.col(b) for b in by], F.col(ts).alias("tm_ts"), F.lit(0).alias("tm_tag"), F.lit(None).cast(left.schema["tm_row"].dataType).alias("tm_row"), cut)
    both = left.unionByName(right)
    one = (F.lit(1) - F.col("tm_tag")).cast("long")
    days = both.groupBy(*by, "tm_bucket").agg(F.sum(one).alias("tm_n"))
    before = F.coalesce(F.sum("tm_n").over(W.partitionBy(*by).orderBy("tm_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select(*[F.col(b).alias(f"tm_{b}") for b in by], F.col("tm_bucket").alias("tm_at"), before.alias("tm_before"))
    same = F.col("tm_bucket") == F.col("tm_at")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"tm_{b}"))
    inside = W.partitionBy(*by, "tm_bucket").orderBy("tm_ts", "tm_tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("tm_seen", F.sum(one).over(inside)).filter("tm_tag = 1").join(days, same)
    return seen.select("tm_row.*", (F.col("tm_seen") + F.col("tm_before")).alias(out))
