"""Reports on tables: missing values, shifts, correlations, time series, crosstabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, quality
from ..streaming import windows
from .bindings import EV, Query, comments, rounded, rounded_sql, table

_DOCS = ["text", "lang", "source", "n_chars"]


def missingness_report(spark, d):
    """Labels joined to all documents: most have none."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(quality.missingness(j, ["doc_id", "text", "quality", "toxic"]))


def _halves(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'")


def shift_check(spark, d):
    return rounded(quality.moments_shift(*_halves(spark, d), "l_extendedprice"), 5)


def ks_shift(spark, d):
    return rounded(quality.ks_statistic(*_halves(spark, d), "l_quantity"))


def correlation_vector(spark, d):
    return rounded(quality.correlations(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 7)


def smoothed_histogram(spark, d):
    return rounded(quality.smooth(quality.histogram(table(spark, d, "lineitem"), "l_quantity", 25, 0.0, 50.0)))


def kernel_density(spark, d):
    return rounded(quality.kde(table(spark, d, "supplier"), "s_acctbal", [0.0, 2500.0, 5000.0, 7500.0]), 9)


def percentile_ranks(spark, d):
    return rounded(quality.percentile_rank(table(spark, d, "orders"), "o_totalprice", 5000.0))


def label_crosstab(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("good"), F.avg("toxic").alias("toxic_rate")))


def format_stats(spark, d):
    p = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price"), F.median("p_retailprice").alias("median_price"), F.stddev_samp("p_retailprice").alias("std_price"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("top_part"))
    return rounded(p, 6)


def day_of_week(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "EEEE").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def media_medians(spark, d):
    """Values missing for errors become the median."""
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(cleaning.fill(e, {"event_type": "none"}, ["value"]).groupBy("event_type").agg(F.avg("value").alias("mean_value")))


def json_clicks(spark, d):
    from ..sources.io import json_columns

    return rounded(json_columns(table(spark, d, "events").select("event_id", "props"), "props", "clicks_").drop("props"))


def inventory(spark, d):
    return quality.inventory({t: table(spark, d, t) for t in ("documents", "events", "orders", "pages")})


def sliding_counts(spark, d):
    """The streaming operator on the same events as a batch."""
    e = comments(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sliding_counts(e, user="user_key", value="words")
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "user_key", "comment_count", "mean_value"))


def sessions(spark, d):
    e = comments(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, user="user_key").groupBy("user_key").agg(F.count(F.lit(1)).alias("visits"), F.max("n").alias("longest"))


_K = "VALUES " + ", ".join(f"({i})" for i in range(-12, 13))
QUERIES: dict[str, Query] = {
    "missingness_report": (missingness_report, rounded_sql("WITH j AS (SELECT d.doc_id, text, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), n AS (SELECT count(*) AS n FROM j) --main " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL)::BIGINT AS n_missing, count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*) AS pct_missing FROM j""" for c in ("doc_id", "text", "quality", "toxic")), "pct_missing")),
    "shift_check": (shift_check, rounded_sql("WITH a AS (SELECT avg(l_extendedprice) AS mean_before, stddev_samp(l_extendedprice) AS std_before FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT avg(l_extendedprice) AS mean_after, stddev_samp(l_extendedprice) AS std_after FROM lineitem WHERE l_returnflag = 'R') --main SELECT *, (mean_after - mean_before) / abs(mean_before) * 100 AS mean_change_pct, (std_after - std_before) / abs(std_before) * 100 AS std_change_pct FROM a, b", "mean_before", "std_before", "mean_after", "std_after", "mean_change_pct", "std_change_pct", digits=5)),
    "ks_shift": (ks_shift, rounded_sql("WITH v AS (SELECT l_quantity AS v, sum((l_returnflag = 'A')::INT) AS a, sum((l_returnflag = 'R')::INT) AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY v)::DOUBLE / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v)::DOUBLE / sum(b) OVER () AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v) --main SELECT max(abs(fa - fb)) AS statistic, max(na)::BIGINT AS n_before, max(nb)::BIGINT AS n_after FROM r", "statistic")),
    "correlation_vector": (correlation_vector, rounded_sql("--main " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", corr(l_extendedprice, {c}) AS r FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")), "r", digits=7)),
    "smoothed_histogram": (
        smoothed_histogram,
        rounded_sql(f"""WITH h AS (SELECT least(floor(l_quantity / 2.0), 24)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1), f AS (SELECT g.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0)::DOUBLE / ((SELECT sum(n) FROM h) * 2.0) AS density FROM range(25) g(bin) LEFT JOIN h ON h.bin = g.bin),
        k AS (SELECT i, exp(-0.5 * (i / 3.0) ** 2) / (SELECT sum(exp(-0.5 * (i / 3.0) ** 2)) FROM ({_K}) z(i)) AS w FROM ({_K}) y(i)) --main SELECT f.bin, f.n, f.density, sum(coalesce(g.density, 0) * w) AS smoothed FROM f CROSS JOIN k LEFT JOIN f g ON g.bin = f.bin + k.i GROUP BY 1, 2, 3""", "density", "smoothed"),
    ),
    "kernel_density": (
        kernel_density,
        rounded_sql("WITH s AS (SELECT least(stddev_samp(s_acctbal), CASE WHEN quantile_cont(s_acctbal, 0.75) > quantile_cont(s_acctbal, 0.25) THEN (quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25)) / 1.34 ELSE stddev_samp(s_acctbal) END) * 0.9 * pow(count(*), -0.2) AS h, count(*) AS n FROM supplier) --main SELECT x::DOUBLE AS x, sum(exp(-0.5 * pow((x - s_acctbal) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM (VALUES (0.0), (2500.0), (5000.0), (7500.0)) g(x), supplier, s GROUP BY 1", "density"),
    ),
    "percentile_ranks": (percentile_ranks, rounded_sql("--main SELECT avg((o_totalprice <= 5000)::INT) AS rank FROM orders", "rank")),
    "label_crosstab": (label_crosstab, rounded_sql("--main SELECT lang, count(*)::BIGINT AS n, sum(quality)::BIGINT AS good, avg(toxic) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1", "toxic_rate")),
    "format_stats": (format_stats, rounded_sql("--main SELECT p_type, count(*)::BIGINT AS n, avg(p_retailprice) AS mean_price, quantile_cont(p_retailprice, 0.5) AS median_price, stddev_samp(p_retailprice) AS std_price, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS top_part FROM part GROUP BY 1", "mean_price", "median_price", "std_price", digits=6)),
    "day_of_week": (day_of_week, "SELECT dayname(ts) AS day, hour(ts)::INT AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"),
    "media_medians": (media_medians, rounded_sql("WITH e AS (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) --main SELECT event_type, avg(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e))) AS mean_value FROM e GROUP BY 1", "mean_value")),
    "json_clicks": (json_clicks, "SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1)::DOUBLE AS clicks_k FROM events"),
    "inventory": (inventory, " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*)::BIGINT AS n_rows, {n} AS n_columns FROM {t}""" for t, n in (("documents", 5), ("events", 6), ("orders", 6), ("pages", 3)))),
    "sliding_counts": (sliding_counts, rounded_sql(f"WITH {EV}, x AS (SELECT *, unnest(range(0, 7)) AS back FROM c) --main SELECT strftime(date_trunc('day', ts) - to_days(back::INT), '%Y-%m-%d') AS window_start, user_key, count(*)::BIGINT AS comment_count, avg(words) AS mean_value FROM x GROUP BY 1, 2", "mean_value")),
    "sessions": (sessions, f"WITH {EV}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_key ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM c), s AS (SELECT user_key, sum(fresh) OVER (PARTITION BY user_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f), n AS (SELECT user_key, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_key, count(*)::BIGINT AS visits, max(n)::BIGINT AS longest FROM n GROUP BY 1"),
}
