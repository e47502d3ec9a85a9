"""Recency, frequency, engagement, clumpiness per period and user, and the six-metric variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .temporal import posts_seen


def last_known(c: str, ts: str = "ts", tie: str = "comment_id") -> Column:
    """The latest value that isn't null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, tie)))


def engagement_metrics(comments: DataFrame, posts: DataFrame, by: str = "era", min_comments: int = 3, recency: str = "share", frequency: str = "posts", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (by, user_key) with at least min_comments comments.

    comments: by, user_key, comment_id, media_id, ts, words and the carried columns; posts: by, ts. The running window and
    all aggregates share the partitioning by (by, user_key), so comments are shuffled for it once. Periods without posts drop out
    (see require_posts).
    """
    total = posts.groupBy(F.col(by).alias("mt_by")).agg(F.count(F.lit(1)).alias("posts_in_period"))
    order = W.partitionBy(by, "user_key").orderBy("ts", "comment_id")
    step = F.col("posts_seen") - F.lag("posts_seen").over(order)
    rows = posts_seen(comments, posts, by=[by]).withColumn("mt_step", step)
    out = rows.groupBy(by, "user_key").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.count_distinct("media_id").alias("distinct_posts_count"),
        F.max("ts").alias("last_ts"),
        F.max_by("posts_seen", F.struct("ts", "comment_id")).alias("last_seen"),
        F.avg("words").alias("engagement"),
        F.stddev_pop("mt_step").alias("clumpiness"),
        *[last_known(c).alias(c) for c in carry],
    )
    since = F.col("posts_in_period") - F.col("last_seen")
    out = out.filter(F.col("comment_count") >= min_comments).join(F.broadcast(total), F.col(by) == F.col("mt_by")).drop("mt_by")  # a row a period
    return out.withColumns({
        "recency": since / F.col("posts_in_period") if recency == "share" else since,
        "frequency": F.col("distinct_posts_count") / F.col("posts_in_period") if frequency == "share" else F.col("distinct_posts_count"),
    }).drop("last_seen")


def require_posts(posts: DataFrame, periods: list[str], by: str = "era") -> None:
    """Raise if a period has no posts: recency would have no base. One row a period reaches the driver."""
    have = {r[0] for r in posts.select(by).distinct().collect()}
    if missing := [p for p in periods if p not in have]:
        raise ValueError(f"no posts in {', '.join(missing)}")


def delay_reference(comments: DataFrame, posts: DataFrame, minutes: int = 2) -> DataFrame:
    """posts with `reference`: their time, or for those known by date alone (midnight) shortly before their first comment."""
    first = comments.groupBy(F.col("media_id").alias("mt_media")).agg(F.min("ts").alias("first_comment_ts"))
    midnight = F.date_format("ts", "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    joined = posts.join(first, F.col("media_id") == F.col("mt_media"), "left").drop("mt_media")
    early = F.col("first_comment_ts") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return joined.withColumn("reference", F.when(midnight & F.col("first_comment_ts").isNotNull(), early).otherwise(F.col("ts")))


def post_concentration(comments: DataFrame, by: list[str]) -> DataFrame:
    """1 - sum of squared shares of a group's comments over its posts: 0 if all are on one post."""
    per_post = comments.groupBy(*by, "media_id").agg(F.count(F.lit(1)).alias("n"))
    return per_post.groupBy(*by).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def hours_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 3.6e9


def six_metrics(comments: DataFrame, posts: DataFrame, history: DataFrame, periods: DataFrame, by: str = "period") -> DataFrame:
    """Recency, coverage, engagement, delay, tenure and concentration for each (by, user_key).

    comments: by, user_key, comment_id, media_id, ts, words; posts: by, media_id, ts; history: user_key, ts of all comments ever; periods: by, stop
    (its exclusive end). Delay is in hours since the post's reference time, at least 0; tenure the days from the first comment ever to
    the last one before the period's end.
    """
    total = posts.groupBy(F.col(by).alias("mt_by")).agg(F.count(F.lit(1)).alias("posts_in_period"))
    refs = delay_reference(comments, posts).select(F.col(by).alias("mt_by"), F.col("media_id").alias("mt_post"), "reference")
    rows = posts_seen(comments, posts, by=[by]).join(refs, (F.col(by) == F.col("mt_by")) & (F.col("media_id") == F.col("mt_post")), "left").drop("mt_by", "mt_post")
    base = rows.groupBy(by, "user_key").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.count_distinct("media_id").alias("distinct_posts_count"),
        F.max_by("posts_seen", F.struct("ts", "comment_id")).alias("last_seen"),
        F.avg("words").alias("engagement"),
        F.avg(F.greatest(hours_between(F.col("ts"), F.col("reference")), F.lit(0.0))).alias("delay"),
    )
    gini = post_concentration(rows, [by, "user_key"])
    tenure = tenures(history, periods, by)
    out = base.join(gini, [by, "user_key"]).join(tenure, [by, "user_key"], "left").join(F.broadcast(total), F.col(by) == F.col("mt_by")).drop("mt_by")
    return out.withColumns({"recency": (F.col("posts_in_period") - F.col("last_seen")) / F.col("posts_in_period"), "coverage": F.col("distinct_posts_count") / F.col("posts_in_period")}).drop("last_seen")


def tenures(history: DataFrame, periods: DataFrame, by: str = "period") -> DataFrame:
    """user_key, by, tenure: days between a user's first comment and the last before the period's end.

    The history is reduced to a row for each user and period in which the user wrote, then carried forward by a running maximum;
    periods are few and set by the specification, so users x periods is the size of the result.
    """
    stops = periods.select(F.col(by).alias("mt_by"), F.col("stop").cast("timestamp_ntz").alias("mt_stop"))
    first = history.groupBy("user_key").agg(F.min("ts").alias("first_ts"))
    # The earliest period end after each comment: its slot. The ends are a short sorted array.
    ends = stops.agg(F.array_sort(F.collect_set("mt_stop")).alias("mt_ends"))
    slotted = history.crossJoin(F.broadcast(ends)).withColumn("mt_slot", F.get(F.filter("mt_ends", lambda e: e > F.col("ts")), F.lit(0))).filter(F.col("mt_slot").isNotNull())
    per_slot = slotted.groupBy("user_key", "mt_slot").agg(F.max("ts").alias("mt_last"))
    grid = first.crossJoin(F.broadcast(stops)).join(per_slot.withColumnRenamed("mt_slot", "mt_stop"), ["user_key", "mt_stop"], "left")
    latest = F.max("mt_last").over(W.partitionBy("user_key").orderBy("mt_stop").rowsBetween(W.unboundedPreceding, W.currentRow))
    return grid.withColumn("mt_latest", latest).filter(F.col("mt_latest").isNotNull()).select("user_key", F.col("mt_by").alias(by), (hours_between(F.col("mt_latest"), F.col("first_ts")) / 24).alias("tenure"))
