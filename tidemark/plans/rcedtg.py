"""Recency, coverage, engagement, delay, tenure and concentration over periods of years and calendar months."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, temporal
from ..operators.cleaning import at_least, content_format, stratified_sample
from .bindings import MONTHS, ORD, PERIODS, Query, order_comments, order_posts, rounded, rounded_sql, seen_sql, table, window_values


def _inputs(spark, d):
    c = at_least(order_comments(spark, d), ["user_key"], 2)
    return c.filter("period IS NOT NULL"), order_posts(spark, d).filter("period IS NOT NULL"), c


def _periods(spark):
    return temporal.interval_table(spark, PERIODS, "period").select(F.col("period_id").alias("period"), F.date_add("period_end", 1).alias("stop"))


def rcedtg_metrics(spark, d):
    """A comment counts in its period if its post lies there too."""
    c, p, history = _inputs(spark, d)
    inside = c.join(p.select(F.col("media_id").alias("p_m"), F.col("period").alias("p_p")), (F.col("media_id") == F.col("p_m")) & (F.col("period") == F.col("p_p")), "left_semi")
    out = metrics.six_metrics(inside, p, history, _periods(spark))
    return rounded(out.select("period", "user_key", "comment_count", "recency", "coverage", "engagement", "delay", "tenure", "gini"))


def post_concentration(spark, d):
    return rounded(metrics.post_concentration(_inputs(spark, d)[0], ["period", "user_key"]))


def first_and_latest_activity(spark, d):
    return rounded(metrics.tenures(_inputs(spark, d)[2], _periods(spark)))


def delay_reference(spark, d):
    c, p, _ = _inputs(spark, d)
    out = metrics.delay_reference(c, p)
    return out.select("media_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.date_format("reference", "yyyy-MM-dd HH:mm:ss").alias("reference"))


def month_window_activity(spark, d):
    c = temporal.explode_windows(_inputs(spark, d)[0], "ts", MONTHS)
    return rounded(c.groupBy("window_id", "window_index").agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("user_key").alias("users"), F.avg("words").alias("engagement")))


def monthly_counts(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def content_format_rules(spark, d):
    """Line items as videos: dates moved on by 26 years, seconds from the quantity."""
    li = table(spark, d, "lineitem").select((F.col("l_shipdate") + F.expr("INTERVAL 26 YEARS")).alias("ts"), (F.col("l_quantity") * 2).alias("seconds"), (F.col("l_returnflag") == "A").alias("carousel"), "l_extendedprice")
    f = li.withColumn("content_format", content_format(F.col("ts"), F.col("seconds"), F.col("carousel")))
    return rounded(f.groupBy("content_format").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"), F.round(F.stddev_samp("seconds"), 4).alias("std_seconds")))


def stratified_sample_sizes(spark, d):
    out = stratified_sample(table(spark, d, "customer"), "c_mktsegment", 0.1, F.col("c_custkey"))
    return out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_IN = f"WITH {ORD}, h AS (SELECT * FROM oc WHERE user_key IN (SELECT user_key FROM oc GROUP BY 1 HAVING count(*) >= 2)), c AS (SELECT * FROM h WHERE period IS NOT NULL), p AS (SELECT * FROM op WHERE period IS NOT NULL)"
_STOPS = "(VALUES " + ", ".join(f"('{w.label}', TIMESTAMP '{w.stop}')" for w in PERIODS) + ") e(period, stop)"
_TENURE = f"(SELECT f.user_key, e.period, date_diff('microsecond', f.first_ts, max(h.ts)) / 86400e6 AS tenure FROM (SELECT user_key, min(ts) AS first_ts FROM h GROUP BY 1) f CROSS JOIN {_STOPS} JOIN h ON h.user_key = f.user_key AND h.ts < e.stop GROUP BY f.user_key, f.first_ts, e.period)"
_REF = "(SELECT p.media_id, p.ts, p.period, CASE WHEN strftime(p.ts, '%H:%M:%S') = '00:00:00' AND f.t IS NOT NULL THEN f.t - INTERVAL 2 MINUTE ELSE p.ts END AS reference FROM p LEFT JOIN (SELECT media_id, min(ts) AS t FROM {c} GROUP BY 1) f ON f.media_id = p.media_id)"

QUERIES: dict[str, Query] = {
    "rcedtg_metrics": (
        rcedtg_metrics,
        rounded_sql(f"""{_IN}, i AS (SELECT c.* FROM c SEMI JOIN p ON c.media_id = p.media_id AND c.period = p.period), np AS (SELECT period, count(*) AS np FROM p GROUP BY 1), s AS {seen_sql("i", "p", "period")},
        b AS (SELECT s.period, s.user_key, count(*)::BIGINT AS comment_count, (max(np) - arg_max(posts_seen, (s.ts, comment_id)))::DOUBLE / max(np) AS recency, count(DISTINCT s.media_id)::DOUBLE / max(np) AS coverage, avg(words) AS engagement,
          avg(greatest(date_diff('microsecond', r.reference, s.ts) / 3.6e9, 0)) AS delay FROM s JOIN np USING (period) LEFT JOIN {_REF.format(c='i')} r ON r.media_id = s.media_id AND r.period = s.period GROUP BY 1, 2),
        gi AS (SELECT period, user_key, 1 - sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS gini FROM (SELECT period, user_key, media_id, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1, 2) --main
        SELECT b.*, t.tenure, gi.gini FROM b JOIN gi USING (period, user_key) LEFT JOIN {_TENURE} t USING (period, user_key)""", "recency", "coverage", "engagement", "delay", "tenure", "gini"),
    ),
    "post_concentration": (post_concentration, rounded_sql(f"{_IN} --main SELECT period, user_key, 1 - sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS gini FROM (SELECT period, user_key, media_id, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1, 2", "gini")),
    "first_and_latest_activity": (first_and_latest_activity, rounded_sql(f"{_IN} --main SELECT * FROM {_TENURE}", "tenure")),
    "delay_reference": (delay_reference, f"{_IN} SELECT media_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(reference, '%Y-%m-%d %H:%M:%S') AS reference FROM {_REF.format(c='c')}"),
    "month_window_activity": (month_window_activity, rounded_sql(f"{_IN} --main SELECT window_id, window_index, count(*)::BIGINT AS comments, count(DISTINCT user_key)::BIGINT AS users, avg(words) AS engagement FROM c JOIN {window_values(MONTHS)} ON c.ts >= w.window_start AND c.ts < w.window_end + 1 GROUP BY 1, 2", "engagement")),
    "monthly_counts": (monthly_counts, "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2"),
    "content_format_rules": (
        content_format_rules,
        rounded_sql("""WITH v AS (SELECT l_shipdate + INTERVAL 26 YEAR AS ts, l_quantity * 2 AS seconds, l_returnflag = 'A' AS carousel FROM lineitem), f AS (SELECT *, CASE WHEN ts < '2021-10-05' AND seconds <= 60.121 THEN 'Standard Feed Video' WHEN ts < '2021-10-05' THEN 'IGTV' WHEN ts < '2022-07-21' THEN 'Instagram Video Merge' WHEN carousel AND seconds <= 60 THEN 'Feed Carousel Video' WHEN NOT carousel THEN 'Reel' ELSE 'Unclassified' END AS content_format FROM v) --main
        SELECT content_format, count(*)::BIGINT AS n, round(avg(seconds), 4) AS mean_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds, round(stddev_samp(seconds), 4) AS std_seconds FROM f GROUP BY 1""", "mean_seconds", "std_seconds"),
    ),
    "stratified_sample_sizes": (stratified_sample_sizes, "SELECT c_mktsegment, greatest(floor(count(*) * 0.1), 1)::BIGINT AS n FROM customer GROUP BY 1"),
}
