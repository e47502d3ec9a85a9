"""The engine's roles on the test tables, in Spark and in SQL.

Events: views are posts, the other events are comments on the medium in props; eras are ten days, sliding windows seven days by one.
Orders: every tenth key is a post, the others comment on the post before them; this table spans years, so
three-year periods and four-month windows run on it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import Interval, assign_interval, day_windows, month_windows

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]

ERAS = (Interval("E1", date(2024, 1, 1), date(2024, 1, 10)), Interval("E2", date(2024, 1, 11), date(2024, 1, 20)), Interval("E3", date(2024, 1, 21), date(2024, 1, 31)))
WINDOWS = day_windows(date(2024, 1, 1), date(2024, 1, 30))
PERIODS = (Interval("P1", date(1995, 1, 1), date(1996, 12, 31)), Interval("P2", date(1997, 1, 1), date(1998, 12, 31)), Interval("P3", date(1999, 1, 1), date(2001, 12, 31)))
MONTHS = month_windows(date(1999, 1, 1), date(2000, 12, 31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").alias("media_id"), assign_interval(F.col("ts"), ERAS).alias("era"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).filter("event_type <> 'view' AND era IS NOT NULL")
    return ev.select(F.col("event_id").alias("comment_id"), F.col("user_id").cast("string").alias("user_key"), "media_id", "ts", F.col("value").alias("words"), "era", "event_type")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'view' AND era IS NOT NULL").select(F.col("event_id").alias("post_id"), "media_id", "ts", "era")


def order_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")
    return o.select(F.col("o_orderkey").alias("comment_id"), F.col("o_custkey").cast("string").alias("user_key"), (F.col("o_orderkey") - F.col("o_orderkey") % 10).alias("media_id"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000).alias("words"), assign_interval(F.col("o_orderdate"), PERIODS).alias("period"))


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0")
    return o.select(F.col("o_orderkey").alias("media_id"), F.col("o_orderdate").alias("ts"), assign_interval(F.col("o_orderdate"), PERIODS).alias("period"))


def _case(ts: str, intervals) -> str:
    return "CASE " + " ".join(f"WHEN {ts} >= TIMESTAMP '{w.start}' AND {ts} < TIMESTAMP '{w.stop}' THEN '{w.label}'" for w in intervals) + " END"


def window_values(intervals) -> str:
    return "(VALUES " + ", ".join(f"('{w.label}', {i + 1}, DATE '{w.start}', DATE '{w.end}', {w.days})" for i, w in enumerate(intervals)) + ") AS w(window_id, window_index, window_start, window_end, window_total_days)"


EV = f"""ev AS (SELECT event_id, user_id, event_type, ts, value, regexp_extract(props, '"k": ([0-9]+)', 1) AS media_id, {_case("ts", ERAS)} AS era FROM events),
c AS (SELECT event_id AS comment_id, user_id::VARCHAR AS user_key, media_id, ts, value AS words, era, event_type FROM ev WHERE event_type <> 'view' AND era IS NOT NULL),
p AS (SELECT event_id AS post_id, media_id, ts, era FROM ev WHERE event_type = 'view' AND era IS NOT NULL)"""
ORD = f"""oc AS (SELECT o_orderkey AS comment_id, o_custkey::VARCHAR AS user_key, o_orderkey - o_orderkey % 10 AS media_id, o_orderdate AS ts, o_totalprice / 1000 AS words, {_case("o_orderdate", PERIODS)} AS period FROM orders WHERE o_orderkey % 10 <> 0),
op AS (SELECT o_orderkey AS media_id, o_orderdate AS ts, {_case("o_orderdate", PERIODS)} AS period FROM orders WHERE o_orderkey % 10 = 0)"""


def seen_sql(comments_: str, posts_: str, by: str) -> str:
    """Comments with posts_seen."""
    return f"""(SELECT * EXCLUDE (tag, n), n AS posts_seen FROM (
      SELECT *, (sum(1 - tag) OVER (PARTITION BY {by} ORDER BY ts, tag ROWS UNBOUNDED PRECEDING))::BIGINT AS n
      FROM (SELECT comment_id, user_key, media_id, ts, words, {by}, 1 AS tag FROM {comments_} UNION ALL BY NAME SELECT ts, {by}, 0 AS tag FROM {posts_})) WHERE tag = 1)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last bits: results are compared to so many digits."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def rounded_sql(sql: str, *cols: str, digits: int = 9) -> str:
    head, _, body = sql.rpartition("--main")
    return f"{head} SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in cols)}) FROM ({body or sql})"
