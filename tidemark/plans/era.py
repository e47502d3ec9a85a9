"""Era metrics, classes, clusters and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmedoids, levels, metrics, quality, temporal
from ..operators.cleaning import at_least
from .bindings import ERAS, EV, Query, comments, events, posts, rounded, rounded_sql, seen_sql

CUTS = {"recency": (0.02, 0.06), "frequency": (12, 18), "engagement": (18.0, 22.0), "clumpiness": (12.0, 16.0)}
FEATURES = [f"{m}_class" for m in CUTS]


def macro(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.engagement_metrics(comments(spark, d), posts(spark, d))
    return out.select("era", "user_key", "comment_count", "distinct_posts_count", "posts_in_period", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "recency", F.col("frequency").cast("long").alias("frequency"), "engagement", "clumpiness")


MACRO = f"""WITH {EV}, n AS (SELECT era, count(*) AS posts_in_period FROM p GROUP BY era), s AS {seen_sql("c", "p", "era")},
st AS (SELECT *, posts_seen - lag(posts_seen) OVER (PARTITION BY era, user_key ORDER BY ts, comment_id) AS step FROM s),
m AS (SELECT era, user_key, count(*)::BIGINT AS comment_count, count(DISTINCT media_id)::BIGINT AS distinct_posts_count, max(posts_in_period)::BIGINT AS posts_in_period, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  (max(posts_in_period) - arg_max(posts_seen, (ts, comment_id)))::DOUBLE / max(posts_in_period) AS recency, count(DISTINCT media_id)::BIGINT AS frequency, avg(words) AS engagement, stddev_pop(step) AS clumpiness
  FROM st JOIN n USING (era) GROUP BY era, user_key HAVING count(*) >= 3)"""


def era_rfe(spark, d):
    return rounded(macro(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return rounded(macro(spark, d)).withColumns({f"{m}_class": levels.two_cut(F.col(m), *t) for m, t in CUTS.items()})


_CLASS = ", ".join(f"CASE WHEN {m} <= {a} THEN 1 WHEN {m} <= {b} THEN 2 WHEN {m} > {b} THEN 3 END AS {m}_class" for m, (a, b) in CUTS.items())
CLASSIFIED = f"{MACRO}, r AS (SELECT * REPLACE (round(recency, 9) AS recency, round(engagement, 9) AS engagement, round(clumpiness, 9) AS clumpiness) FROM m), k AS (SELECT *, {_CLASS} FROM r)"


def era_rfe_top_level(spark, d):
    """Only purchases and clicks count as comments of the top level."""
    top = comments(spark, d).filter(F.col("event_type").isin("purchase", "click"))
    out = metrics.engagement_metrics(top, posts(spark, d), min_comments=2, recency="count", frequency="share")
    return rounded(out.select("era", "user_key", "comment_count", "recency", "frequency", "engagement"))


TOP = f"""WITH {EV}, t AS (SELECT * FROM c WHERE event_type IN ('purchase', 'click')), n AS (SELECT era, count(*) AS np FROM p GROUP BY era), s AS {seen_sql("t", "p", "era")} --main
SELECT era, user_key, count(*)::BIGINT AS comment_count, (max(np) - arg_max(posts_seen, (ts, comment_id)))::BIGINT AS recency, count(DISTINCT media_id)::DOUBLE / max(np) AS frequency, avg(words) AS engagement
FROM s JOIN n USING (era) GROUP BY era, user_key HAVING count(*) >= 2"""


def era_assignment(spark, d):
    return events(spark, d).groupBy(F.coalesce("era", F.lit("none")).alias("era"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def posts_seen_asof(spark, d):
    return temporal.posts_seen(comments(spark, d), posts(spark, d), by=["era"]).select("comment_id", "era", "posts_seen")


def eligible_users(spark, d):
    return at_least(comments(spark, d), ["era", "user_key"], 20).groupBy("era").agg(F.count_distinct("user_key").alias("users"), F.count(F.lit(1)).alias("comments"))


def user_last_non_null(spark, d):
    c = comments(spark, d).withColumn("label", F.when(F.col("event_type") != "error", F.col("event_type")))
    return c.groupBy("user_key").agg(metrics.last_known("label").alias("last_label"), metrics.last_known("media_id").alias("last_media"))


def clumpiness(spark, d):
    return rounded(macro(spark, d).select("era", "user_key", "clumpiness"))


def recency_quantiles(spark, d):
    return rounded(levels.group_quantiles(macro(spark, d), ["era"], ["recency", "engagement"], [0.33, 0.67], 2))


def level_classification(spark, d):
    """Recency by the era's quantiles; frequency and engagement by fixed cuts, engagement strictly."""
    m = rounded(macro(spark, d))
    q = levels.group_quantiles(m, ["era"], ["recency"], [0.33, 0.67], 2)
    j = m.join(F.broadcast(q), "era")
    j = j.withColumns({"r_level": levels.three_levels(F.col("recency"), F.col("recency_p33"), F.col("recency_p67")), "f_level": levels.three_levels(F.col("frequency"), 12, 18), "e_level": levels.three_levels(F.col("engagement"), 18.0, 22.0, strict=True)})
    return j.select("era", "user_key", "r_level", "f_level", "e_level", levels.profile({"R": F.col("r_level"), "F": F.col("f_level"), "E": F.col("e_level")}).alias("profile"))


def class_two_cut(spark, d):
    return classified(spark, d).select("era", "user_key", *FEATURES)


def profile_compression(spark, d):
    return levels.compress(classified(spark, d), FEATURES)


def profile_weights_balanced(spark, d):
    return rounded(levels.balanced_profiles(classified(spark, d), FEATURES))


def cluster_composition(spark, d):
    c = classified(spark, d).withColumn("cluster", F.concat_ws("-", "recency_class", "engagement_class"))
    return rounded(levels.composition(c, "era", "cluster"))


def class_value_shares(spark, d):
    return rounded(levels.value_shares(classified(spark, d), "era", FEATURES, [1, 2, 3]))


def cluster_profile_modes(spark, d):
    c = classified(spark, d)
    top = c.groupBy("era", "recency_class", "engagement_class").agg(F.count(F.lit(1)).alias("n"))
    best = top.groupBy("era").agg(F.max_by(F.struct("recency_class", "engagement_class"), F.struct("n", -F.col("recency_class"), -F.col("engagement_class"))).alias("b"))
    modes = c.groupBy("era").agg(F.count(F.lit(1)).alias("n"), *[F.mode(f, True).alias(f"{f}_mode") for f in FEATURES], F.avg("recency").alias("mean_recency"))
    return rounded(modes.join(best, "era").select("era", "n", *[f"{f}_mode" for f in FEATURES], "mean_recency", F.concat_ws("-", "b.recency_class", "b.engagement_class").alias("top_profile")))


PROTOTYPES = [[1, 1, 1, 1], [2, 2, 2, 2], [3, 3, 3, 3], [1, 3, 2, 1]]


def nearest_prototype(spark, d):
    return levels.nearest_prototype(classified(spark, d), FEATURES, PROTOTYPES).select("era", "user_key", "cluster", "distance")


def weighted_kmedoids(spark, d):
    c = classified(spark, d)
    out = kmedoids.cluster_rows(c, FEATURES, [3, 4, 5], weight=levels.balanced_profiles(c, FEATURES))
    return out.select("era", "user_key", *FEATURES, "cluster")


def zscore_profile(spark, d):
    return rounded(levels.zscore(rounded(macro(spark, d)), ["recency", "engagement"]).select("era", "user_key", "z_recency", "z_engagement"))


def centroids_minmax(spark, d):
    c = classified(spark, d).groupBy("era", "recency_class").agg(F.avg("recency").alias("recency"), F.avg(F.log1p(F.col("frequency").cast("double"))).alias("log_frequency"), F.avg("engagement").alias("engagement"))
    return rounded(levels.minmax(c, ["recency", "log_frequency", "engagement"], ["recency"]), 5)


def threshold_cumulative_share(spark, d):
    return rounded(quality.threshold_shares(rounded(macro(spark, d)), {"recency": [0.02, 0.06], "engagement": [18.0, 22.0]}, "era"))


def histogram_density(spark, d):
    return rounded(quality.histogram(rounded(macro(spark, d)), "engagement", 24, 10.0, 34.0))


def ecdf(spark, d):
    return rounded(quality.ecdf(macro(spark, d), "comment_count"))


_DIST = "least(" + ", ".join("+".join(f"abs({f} - {x})" for f, x in zip(FEATURES, p)) for p in PROTOTYPES) + ")"
_CELLS = " UNION ALL ".join(f"SELECT era, '{f}' AS metric, {f} AS value FROM k" for f in FEATURES)
_GRID = f"(SELECT e.era, f.metric, v.value FROM (SELECT DISTINCT era FROM k) e, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in FEATURES)}) f(metric), (VALUES (1), (2), (3)) v(value))"
_MM = lambda c, inv=False: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE {'1 - ' if inv else ''}({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS scaled_{c}"
_SHARE = " UNION ALL ".join(f"SELECT {g} AS grp, '{m}' AS metric, {t}::DOUBLE AS threshold, avg(({m} <= {t})::INT) AS share FROM r {w}" for m, ts in {"recency": [0.02, 0.06], "engagement": [18.0, 22.0]}.items() for t in ts for g, w in (("'all'", ""), ("era", "GROUP BY era")))

QUERIES: dict[str, Query] = {
    "era_rfe": (era_rfe, rounded_sql(f"{MACRO} --main SELECT * FROM m", "recency", "engagement", "clumpiness")),
    "era_rfe_top_level": (era_rfe_top_level, rounded_sql(TOP, "frequency", "engagement")),
    "era_assignment": (era_assignment, f"WITH {EV} SELECT coalesce(era, 'none') AS era, event_type, count(*)::BIGINT AS n FROM ev GROUP BY 1, 2"),
    "posts_seen_asof": (posts_seen_asof, f"WITH {EV}, s AS {seen_sql('c', 'p', 'era')} SELECT comment_id, era, posts_seen FROM s"),
    "eligible_users": (eligible_users, f"WITH {EV}, g AS (SELECT era, user_key, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 20) SELECT era, count(*)::BIGINT AS users, sum(n)::BIGINT AS comments FROM g GROUP BY era"),
    "user_last_non_null": (user_last_non_null, f"WITH {EV} SELECT user_key, arg_max(event_type, (ts, comment_id)) FILTER (event_type <> 'error') AS last_label, arg_max(media_id, (ts, comment_id)) FILTER (media_id IS NOT NULL) AS last_media FROM c GROUP BY user_key"),
    "clumpiness": (clumpiness, rounded_sql(f"{MACRO} --main SELECT era, user_key, clumpiness FROM m", "clumpiness")),
    "recency_quantiles": (recency_quantiles, f"{MACRO} SELECT era, round_even(quantile_cont(recency, 0.33), 2) AS recency_p33, round_even(quantile_cont(recency, 0.67), 2) AS recency_p67, round_even(quantile_cont(engagement, 0.33), 2) AS engagement_p33, round_even(quantile_cont(engagement, 0.67), 2) AS engagement_p67 FROM m GROUP BY era"),
    "level_classification": (
        level_classification,
        f"""{CLASSIFIED}, q AS (SELECT era, round_even(quantile_cont(recency, 0.33), 2) AS lo, round_even(quantile_cont(recency, 0.67), 2) AS hi FROM r GROUP BY era),
        l AS (SELECT era, user_key, CASE WHEN recency <= lo THEN 'Low' WHEN recency <= hi THEN 'Medium' ELSE 'High' END AS r_level, CASE WHEN frequency <= 12 THEN 'Low' WHEN frequency <= 18 THEN 'Medium' ELSE 'High' END AS f_level,
          CASE WHEN engagement < 18 THEN 'Low' WHEN engagement < 22 THEN 'Medium' ELSE 'High' END AS e_level FROM r JOIN q USING (era))
        SELECT *, 'R=' || r_level || ' | F=' || f_level || ' | E=' || e_level AS profile FROM l""",
    ),
    "class_two_cut": (class_two_cut, f"{CLASSIFIED} SELECT era, user_key, {', '.join(FEATURES)} FROM k"),
    "profile_compression": (profile_compression, f"{CLASSIFIED} SELECT {', '.join(FEATURES)}, count(*)::BIGINT AS weight FROM k GROUP BY {', '.join(FEATURES)}"),
    "profile_weights_balanced": (
        profile_weights_balanced,
        rounded_sql(f"""{CLASSIFIED}, pe AS (SELECT era, {', '.join(FEATURES)}, count(*) AS n FROM k GROUP BY ALL), ez AS (SELECT era, sum(n) AS rows_ FROM pe GROUP BY era) --main
        SELECT {', '.join(FEATURES)}, sum(n * (SELECT avg(rows_) FROM ez) / rows_) AS balanced_weight, sum(n)::BIGINT AS raw_count, count(DISTINCT era)::BIGINT AS eras_present FROM pe JOIN ez USING (era) GROUP BY {', '.join(FEATURES)}""", "balanced_weight"),
    ),
    "cluster_composition": (cluster_composition, rounded_sql(f"{CLASSIFIED}, g AS (SELECT era, recency_class || '-' || engagement_class AS cluster, count(*)::BIGINT AS n FROM k GROUP BY 1, 2) --main SELECT era, cluster, n, (sum(n) OVER (PARTITION BY era))::BIGINT AS total, n / sum(n) OVER (PARTITION BY era) AS share FROM g", "share")),
    "class_value_shares": (class_value_shares, rounded_sql(f"{CLASSIFIED}, v AS ({_CELLS}) --main SELECT g.era, g.metric, g.value, count(v.value)::BIGINT AS n, count(v.value)::DOUBLE / (SELECT count(*) FROM v x WHERE x.era = g.era AND x.metric = g.metric AND x.value IS NOT NULL) AS share FROM {_GRID} g LEFT JOIN v ON v.era = g.era AND v.metric = g.metric AND v.value = g.value GROUP BY g.era, g.metric, g.value", "share")),
    "cluster_profile_modes": (
        cluster_profile_modes,
        rounded_sql(f"""{CLASSIFIED}, {', '.join(f'm{i} AS (SELECT era, {f} AS v FROM (SELECT era, {f}, row_number() OVER (PARTITION BY era ORDER BY count(*) DESC, {f}) AS rn FROM k WHERE {f} IS NOT NULL GROUP BY era, {f}) WHERE rn = 1)' for i, f in enumerate(FEATURES))},
        tp AS (SELECT era, recency_class || '-' || engagement_class AS top_profile FROM (SELECT era, recency_class, engagement_class, row_number() OVER (PARTITION BY era ORDER BY count(*) DESC, recency_class, engagement_class) AS rn FROM k GROUP BY 1, 2, 3) WHERE rn = 1),
        b AS (SELECT era, count(*)::BIGINT AS n, avg(recency) AS mean_recency FROM k GROUP BY era) --main
        SELECT b.era, b.n, {', '.join(f'm{i}.v AS {f}_mode' for i, f in enumerate(FEATURES))}, mean_recency, top_profile FROM b JOIN tp USING (era) {' '.join(f'JOIN m{i} USING (era)' for i in range(len(FEATURES)))}""", "mean_recency"),
    ),
    "nearest_prototype": (nearest_prototype, f"{CLASSIFIED}, x AS (SELECT era, user_key, {_DIST} AS dist, {', '.join('+'.join(f'abs({f} - {x})' for f, x in zip(FEATURES, p)) + f' AS d{i}' for i, p in enumerate(PROTOTYPES))} FROM k) SELECT era, user_key, CASE WHEN d0 = dist THEN 1 WHEN d1 = dist THEN 2 WHEN d2 = dist THEN 3 ELSE 4 END AS cluster, dist::DOUBLE AS distance FROM x"),
    "weighted_kmedoids": (weighted_kmedoids, None),
    "zscore_profile": (zscore_profile, rounded_sql(f"{CLASSIFIED} --main SELECT era, user_key, (recency - avg(recency) OVER ()) / stddev_pop(recency) OVER () AS z_recency, (engagement - avg(engagement) OVER ()) / stddev_pop(engagement) OVER () AS z_engagement FROM r", "z_recency", "z_engagement")),
    "centroids_minmax": (
        centroids_minmax,
        rounded_sql(f"{CLASSIFIED}, g AS (SELECT era, recency_class, avg(recency) AS recency, avg(ln(1 + frequency)) AS log_frequency, avg(engagement) AS engagement FROM k GROUP BY 1, 2) --main SELECT *, {_MM('recency', True)}, {_MM('log_frequency')}, {_MM('engagement')} FROM g", "recency", "log_frequency", "engagement", "scaled_recency", "scaled_log_frequency", "scaled_engagement", digits=5),
    ),
    "threshold_cumulative_share": (threshold_cumulative_share, rounded_sql(f"{CLASSIFIED} --main {_SHARE}", "share")),
    "histogram_density": (histogram_density, rounded_sql(f"{CLASSIFIED}, h AS (SELECT least(floor((engagement - 10.0) / 1.0), 23)::INT AS bin, count(*) AS n FROM r WHERE engagement BETWEEN 10 AND 34 GROUP BY 1) --main SELECT g.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM h) AS density FROM range(24) g(bin) LEFT JOIN h ON h.bin = g.bin", "density")),
    "ecdf": (ecdf, rounded_sql(f"{MACRO}, g AS (SELECT comment_count AS value, count(*)::BIGINT AS n FROM m GROUP BY 1) --main SELECT value, n, (sum(n) OVER (ORDER BY value))::BIGINT AS cumulative, (sum(n) OVER (ORDER BY value))::DOUBLE / (SELECT sum(n) FROM g) AS share FROM g", "share")),
}
