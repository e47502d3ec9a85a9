"""Selections, preferred records, joins of context, cluster summaries, cut points from ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, levels, quality, selection
from .bindings import EV, Query, comments, events, posts, rounded, rounded_sql, table
from .content import docs, turns, _TURNS, _WORDS
from .dynamic import _SEEN, _levels, _LV, metrics_of
from .era import CLASSIFIED, FEATURES, classified, macro
from .rcedtg import _IN, _TENURE, first_and_latest_activity


def platform_filter(spark, d):
    return selection.on_platforms(docs(spark, d), ["SRC1", "src2"], "source").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def year_split(spark, d):
    o = selection.in_years(table(spark, d, "orders"), 1996, 1998, "o_orderdate").withColumn("is_short", F.col("o_orderstatus") == "F")
    short, long = selection.split_kinds(o)
    n = lambda df, kind: df.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return n(short, "short").unionByName(n(long, "long"))


def missing_ids(spark, d):
    return selection.missing_from(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


def commented_media(spark, d):
    p = selection.known_in(posts(spark, d), comments(spark, d).filter("words > 90"), "media_id")
    return p.groupBy("media_id").agg(F.count(F.lit(1)).alias("posts"))


def preferred_record(spark, d):
    """Of each source and language the longest text's document."""
    rows = docs(spark, d).withColumn("k", F.concat_ws("/", "source", "lang"))
    return selection.prefer(rows, "k", [F.desc("n_chars"), F.col("doc_id")]).select("k", "doc_id", "n_chars")


def latest_long(spark, d):
    return selection.latest_per_group(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "o_custkey", "o_orderdate", 3, "o_orderkey").select("o_custkey", "o_orderkey")


def user_sample(spark, d):
    s = selection.sample_with_top_up(table(spark, d, "customer"), 50, "c_mktsegment", "c_custkey")
    return s.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def era_order(spark, d):
    return selection.era_order(events(spark, d).filter("era IS NOT NULL"), "era", "ts")


def evenly_spaced_words(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(selection.evenly_spaced(T.words(F.col("text")), 5), " ").alias("words"))


def comment_context(spark, d):
    """Every turn with its conversation's first text."""
    t = turns(spark, d)
    first = t.filter("turn = 0").select("media_id", "text", "author_id")
    out = selection.with_context(t, first, "media_id", {"author_id": "opened_by"})
    return out.groupBy("author_id", "opened_by").agg(F.count(F.lit(1)).alias("n"))


def unified_records(spark, d):
    t = table(spark, d, "conversations")
    ev = table(spark, d, "events").withColumn("m", F.get_json_object("props", "$.k"))
    out = selection.unified({"chat": (t, {"author_id": "role", "media_id": "conv_id", "text": "text"}), "web": (ev, {"comment_id": "event_id", "author_id": "user_id", "media_id": "m"})})
    return out.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author_id").alias("authors"), F.count("text").alias("texts"))


def token_metrics(spark, d):
    """Marks by length, and long words as stand-ins for nouns."""
    t = F.coalesce("text", F.lit(""))
    return rounded(turns(spark, d).select("comment_id", (T.count_of(t, r"[.,!?;:]") / F.greatest(F.length(t), F.lit(1))).alias("punctuation"), F.size(F.array_distinct(F.filter(T.words(F.lower(t)), lambda w: F.length(w) > 3))).cast("long").alias("nouns")))


def name_shares(spark, d):
    return rounded(docs(spark, d).agg(F.avg(F.col("text").rlike(r"[\x{1F300}-\x{1FAFF}]").cast("double")).alias("emoji_share"), F.avg(F.col("text").rlike("license").cast("double")).alias("license_share")))


def batch_results(spark, d):
    """Labels as results of a model: documents without one are errors."""
    results = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), (F.col("quality") * 0.6 + 0.2).alias("confidence"))
    out = selection.with_results(docs(spark, d).select("doc_id"), results, ["doc_id"])
    n = F.count(F.lit(1))
    return rounded(out.agg(n.alias("n"), F.avg((F.col("label") != "ERROR").cast("double")).alias("coverage"), F.avg("confidence").alias("mean_confidence"), F.median("confidence").alias("median_confidence"), F.count(F.when(F.col("confidence") < 0.4, 1)).alias("low"), (n - F.count_distinct("doc_id")).alias("duplicates")))


def latest_result(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return selection.idempotent(e, ["user_id", "event_type"], "event_id")


def cluster_summary(spark, d):
    p = levels.compress(classified(spark, d), FEATURES).withColumn("cluster", F.col("recency_class"))
    return rounded(clusters.summary(p, FEATURES))


def cluster_level_shares(spark, d):
    l = _levels(spark, d).withColumn("cluster", F.col("user_key").cast("int") % 4)  # noqa: E741
    return rounded(clusters.level_shares(l, ["recency", "frequency", "engagement"], ["Low", "Mid", "High"]))


def cluster_names(spark, d):
    p = levels.compress(classified(spark, d), FEATURES)
    out = clusters.named(p, [((F.col("recency_class") == 1) & (F.col("frequency_class") == 3), "Loyal"), (F.col("recency_class") == 3, "Lapsed"), (F.col("engagement_class") == 3, "Talkative")])
    return clusters.rank_order(out.groupBy("cluster_name").agg(F.sum("weight").alias("rows")), ["Loyal", "Talkative", "Lapsed"], "cluster_name")


def rank_derived_cuts(spark, d):
    """Cuts at the quantiles that two fixed values have among all: their percentile rank, then the value at it."""
    m = rounded(macro(spark, d))
    r = m.agg(*[F.avg((F.col("comment_count") <= v).cast("double")).alias(f"rank_{v}") for v in (15, 20)])
    q = quality.quantiles(m, "recency", {"recency_p30": 0.3, "recency_p70": 0.7}).crossJoin(quality.quantiles(m, "engagement", {"engagement_p60": 0.6, "engagement_p90": 0.9}))
    return rounded(r.crossJoin(q))


def tenure_levels(spark, d):
    """Tenure by the quantiles of each period."""
    t = first_and_latest_activity(spark, d)
    cuts = levels.group_quantiles(t, ["period"], ["tenure"], [0.3, 0.7])
    j = t.join(F.broadcast(cuts), "period")  # a row a period
    return j.select("period", "user_key", levels.three_levels(F.col("tenure"), F.col("tenure_p30"), F.col("tenure_p70"), missing=None).alias("level"))


def kmeans_windows(spark, d):
    """Spark's own k-means: sizes of the clusters vary with its seeding, so they are reported, not compared."""
    out = clusters.kmeans(metrics_of(spark, d), ["recency", "frequency", "engagement"], 4)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def pca_profiles(spark, d):
    return rounded(clusters.pca(macro(spark, d), ["recency", "frequency", "engagement", "clumpiness"]).select("era", "user_key", "pc_1", "pc_2"), 6)


def group_argmax(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return clusters.argmax_rows(y, "year", "n", "o_orderpriority")


_PROF = f"{CLASSIFIED}, pf AS (SELECT {', '.join(FEATURES)}, count(*)::BIGINT AS weight FROM k GROUP BY {', '.join(FEATURES)})"
_KEY = "concat_ws('-', " + ", ".join(FEATURES) + ")"
_TIE = ", ".join(f"-{f}" for f in FEATURES)
_LS = f"{_SEEN}, l AS (SELECT user_key::INT % 4 AS cluster, {', '.join(f'{e} AS {m}' for m, e in _LV.items())} FROM m), u AS (" + " UNION ALL ".join(f"SELECT cluster, '{m}' AS metric, {m} AS value FROM l" for m in _LV) + "), ls AS (SELECT cluster, metric, avg((value = 'Low')::INT) AS share_low, avg((value = 'Mid')::INT) AS share_mid, avg((value = 'High')::INT) AS share_high FROM u GROUP BY 1, 2)"

QUERIES: dict[str, Query] = {
    "platform_filter": (platform_filter, "SELECT source, lang, count(*)::BIGINT AS n FROM documents WHERE lower(source) IN ('src1', 'src2') GROUP BY 1, 2"),
    "year_split": (year_split, "SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS n, CASE WHEN o_orderstatus = 'F' THEN 'short' ELSE 'long' END AS kind FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1, 3"),
    "missing_ids": (missing_ids, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "commented_media": (commented_media, f"WITH {EV} SELECT media_id, count(*)::BIGINT AS posts FROM p WHERE media_id IN (SELECT media_id FROM c WHERE words > 90) GROUP BY 1"),
    "preferred_record": (preferred_record, "SELECT source || '/' || lang AS k, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1"),
    "latest_long": (latest_long, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn <= 3"),
    "user_sample": (user_sample, "SELECT c_mktsegment, 10::BIGINT AS n FROM customer GROUP BY 1 HAVING count(*) >= 10"),
    "era_order": (era_order, f"WITH {EV} SELECT era, (row_number() OVER (ORDER BY min(ts)))::INT AS era_index FROM ev WHERE era IS NOT NULL GROUP BY era"),
    "evenly_spaced_words": (evenly_spaced_words, f"WITH w AS (SELECT doc_id, {_WORDS.format(t='coalesce(text, chr(32))')} AS ws FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(ws) <= 5 THEN ws ELSE [" + ", ".join(f"ws[round_even({i} * (len(ws) - 1) / 4.0, 0)::INT + 1]" for i in range(5)) + "] END, ' ') AS words FROM w"),
    "comment_context": (comment_context, f"WITH t AS {_TURNS} SELECT t.author_id, f.author_id AS opened_by, count(*)::BIGINT AS n FROM t LEFT JOIN (SELECT media_id, author_id FROM t WHERE turn = 0) f ON f.media_id = t.media_id GROUP BY 1, 2"),
    "unified_records": (unified_records, "SELECT 'chat' AS platform, count(*)::BIGINT AS n, count(DISTINCT role)::BIGINT AS authors, count(text)::BIGINT AS texts FROM conversations WHERE trim(role) <> '' UNION ALL SELECT 'web', count(*)::BIGINT, count(DISTINCT user_id)::BIGINT, 0::BIGINT FROM events"),
    "token_metrics": (token_metrics, rounded_sql(f"WITH t AS (SELECT comment_id, coalesce(text, '') AS t, list_distinct(list_filter({_WORDS.format(t='lower(coalesce(text, chr(32)))')}, lambda w: length(w) > 3)) AS ws FROM {_TURNS}) --main SELECT comment_id, len(regexp_extract_all(t, '[.,!?;:]'))::DOUBLE / greatest(length(t), 1) AS punctuation, len(ws)::BIGINT AS nouns FROM t", "punctuation")),
    "name_shares": (name_shares, rounded_sql("--main SELECT avg(regexp_matches(text, '[\\x{1F300}-\\x{1FAFF}]')::INT) AS emoji_share, avg(regexp_matches(text, 'license')::INT) AS license_share FROM documents", "emoji_share", "license_share")),
    "batch_results": (batch_results, rounded_sql("WITH r AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS has, coalesce(quality * 0.6::DOUBLE + 0.2::DOUBLE, 0) AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) --main SELECT count(*)::BIGINT AS n, avg(has::INT) AS coverage, avg(confidence) AS mean_confidence, quantile_cont(confidence, 0.5) AS median_confidence, count(*) FILTER (confidence < 0.4)::BIGINT AS low, (count(*) - count(DISTINCT doc_id))::BIGINT AS duplicates FROM r", "coverage", "mean_confidence", "median_confidence")),
    "latest_result": (latest_result, "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2"),
    "cluster_summary": (cluster_summary, rounded_sql(f"{_PROF} --main SELECT recency_class AS cluster, count(*)::BIGINT AS profiles, sum(weight)::BIGINT AS weight, {', '.join(f'sum(weight * {f})::DOUBLE / sum(weight) AS mean_{f}' for f in FEATURES)}, arg_max({_KEY}, (weight, {_TIE})) AS top_profile, max(weight)::DOUBLE / sum(weight) AS top_share, sum(weight)::DOUBLE / (SELECT sum(weight) FROM pf) AS share FROM pf GROUP BY 1", *[f"mean_{f}" for f in FEATURES], "top_share", "share")),
    "cluster_level_shares": (cluster_level_shares, rounded_sql(f"{_LS} --main SELECT *, CASE WHEN share_low >= share_mid AND share_low >= share_high THEN 'Low' WHEN share_mid >= share_high THEN 'Mid' ELSE 'High' END AS dominant FROM ls", "share_low", "share_mid", "share_high")),
    "cluster_names": (cluster_names, f"{_PROF} SELECT CASE WHEN recency_class = 1 AND frequency_class = 3 THEN 'Loyal' WHEN recency_class = 3 THEN 'Lapsed' WHEN engagement_class = 3 THEN 'Talkative' ELSE 'Mixed' END AS cluster_name, sum(weight)::BIGINT AS rows FROM pf GROUP BY 1"),
    "rank_derived_cuts": (rank_derived_cuts, rounded_sql(f"{CLASSIFIED} --main SELECT avg((comment_count <= 15)::INT) AS rank_15, avg((comment_count <= 20)::INT) AS rank_20, quantile_cont(recency, 0.3) AS recency_p30, quantile_cont(recency, 0.7) AS recency_p70, quantile_cont(engagement, 0.6) AS engagement_p60, quantile_cont(engagement, 0.9) AS engagement_p90 FROM r", "rank_15", "rank_20", "recency_p30", "recency_p70", "engagement_p60", "engagement_p90")),
    "tenure_levels": (tenure_levels, f"{_IN}, t AS (SELECT user_key, period, round(tenure, 9) AS tenure FROM {_TENURE}), q AS (SELECT period, quantile_cont(tenure, 0.3) AS lo, quantile_cont(tenure, 0.7) AS hi FROM t GROUP BY 1) SELECT period, user_key, CASE WHEN tenure <= lo THEN 'Low' WHEN tenure <= hi THEN 'Medium' ELSE 'High' END AS level FROM t JOIN q USING (period)"),
    "kmeans_windows": (kmeans_windows, None),
    "pca_profiles": (pca_profiles, None),
    "group_argmax": (group_argmax, "SELECT year, o_orderpriority, n FROM (SELECT year(o_orderdate)::INT AS year, o_orderpriority, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY year(o_orderdate), o_orderpriority) WHERE rn = 1"),
}
