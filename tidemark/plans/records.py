"""Comments as they come: cleaning, emoji, flags, small joins and reports on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emoji, text as T
from ..operators import cleaning, features, kmedoids, levels, quality, selection, similarity
from .bindings import Query, rounded, rounded_sql, table
from .content import _TURNS, _WORDS, docs, feature_sql, turns
from .era import CLASSIFIED, FEATURES, classified

GRIN, JOY, THUMB, FLAG, HEART = "\U0001f600", "\U0001f602", "\U0001f44d\U0001f3fd", "\U0001f1ee\U0001f1f9", "❤️"
#: text; words with emoji in a row as one; words with equal neighbours as one; emoji units.
EMOJI_CASES = [
    (f"{GRIN}{GRIN}{JOY} hi", 2, 3, 3), ("1️⃣", 1, 1, 1), (FLAG, 1, 1, 1), ("\U0001f468‍\U0001f469‍\U0001f467", 1, 1, 1), (THUMB, 1, 1, 1), ("hello️", 2, 1, 0), ("a‍", 2, 1, 0), ("", 0, 0, 0),
    (f"hi{GRIN}there", 3, 3, 1), ("12️⃣", 2, 2, 1), (f"{GRIN} {GRIN}", 2, 2, 2), ("it's 5.30 @ann #tag http://x.y/z", 5, 5, 0), ("\U0001f3fd", 1, 0, 0), (f"{HEART}{HEART}{HEART}", 1, 1, 3), ("\U0001f1ee", 1, 1, 1),
]


def emoji_cases(spark, d):
    t = spark.createDataFrame([(i, c[0]) for i, c in enumerate(EMOJI_CASES)], "case_no long, text string")
    return t.select("case_no", emoji.word_count_runs("text").alias("runs"), emoji.word_count("text").alias("words"), F.size(emoji.emoji_units("text")).alias("units"))


TAILS = ["", f" {GRIN}", f" {GRIN}{GRIN}{JOY}", f" {THUMB} {FLAG} {HEART}"]
_TAIL_SQL = "CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS)) + " END"
_N = [0, 1, 3, 3]
_ENTROPY = "CASE turn % 4 WHEN 2 THEN -(2.0 / 3 * ln(2.0 / 3) + 1.0 / 3 * ln(1.0 / 3)) WHEN 3 THEN ln(3.0) ELSE 0.0 END"
_TAILED = f"(SELECT * REPLACE (text || {_TAIL_SQL} AS text) FROM {_TURNS})"
_EMOJI = f"(SELECT *, (CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END)::BIGINT AS emoji_count, (turn % 4)::BIGINT AS unique_emoji_count, {_ENTROPY} AS emoji_entropy, (CASE turn % 4 WHEN 0 THEN 0 WHEN 2 THEN 2.0 / 3 ELSE 1 END)::DOUBLE AS emoji_variety_ratio, CASE WHEN word_count > 0 THEN emoji_count::DOUBLE / word_count ELSE 0 END AS emoji_per_word_ratio FROM {feature_sql(_TAILED)})"


def emoji_turns(spark, d):
    """Turns with emoji at their end, and all features of a comment."""
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("turn") % 4 + 1).cast("int"))
    t = turns(spark, d).select("comment_id", "media_id", "author_id", "platform", "reply_to", "turn", F.concat("text", tail).alias("text"))
    return features.with_comment_features(t.withColumn("found", emoji.emoji_units("text")), emoji_col="found")


def comment_emoji_features(spark, d):
    return rounded(emoji_turns(spark, d).select("comment_id", "word_count", "emoji_count", "unique_emoji_count", "emoji_entropy", "emoji_variety_ratio", "emoji_per_word_ratio"))


def media_emoji_features(spark, d):
    return rounded(features.media_features(emoji_turns(spark, d)))


def user_emoji_matrix(spark, d):
    return rounded(features.user_matrix(emoji_turns(spark, d)).select("author_id", "platform", "mean_emoji_count", "mean_unique_emoji_count", "emoji_usage_rate"))


def emoji_categories(spark, d):
    found = docs(spark, d).select("doc_id", emoji.emoji_units(F.concat("text", F.lit(f" {HEART}{JOY}{JOY} \U0001f914{FLAG}"))).alias("found"))
    return found.select("doc_id", T.categories(F.col("found"), T.emoji_table()).alias("k")).select("doc_id", *[F.coalesce(F.try_element_at("k", F.lit(c)), F.lit(0)).alias(c) for c in ("love", "humor", "inquiry", "celebration", "other")])


def emoji_names(spark, d):
    """Composed letters and named emoji around the language's code."""
    t = F.concat(F.lit("é "), "lang", F.lit(f" {GRIN}{THUMB}"))
    return docs(spark, d).select("doc_id", T.composed(t, emoji_names=True).alias("named"))


def _raw_comments(spark, d):
    """Turns as raw comments: ids that are blank or missing, a creator, flags that aren't known, texts that are null."""
    t, n = table(spark, d, "conversations"), F.col("conv_id") * 7 + F.col("turn")
    return t.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"), F.when(n % 11 != 0, "text").alias("dummy"), F.when(n % 13 != 0, F.col("text")).alias("text"),
        F.when(n % 3 == 0, "  ").when(n % 3 == 1, F.concat(F.lit(" u"), (n % 50).cast("string"), F.lit(" "))).alias("from_id"), F.when(n % 5 != 0, F.concat(F.lit(" Name"), (n % 20).cast("string"))).alias("from_username"),
        F.when(n % 17 == 0, None).otherwise(n % 19 == 0).alias("is_creator"), F.when(F.col("turn") > 0, "c").otherwise("0").alias("parent_id"),
    )


_RAW = """(SELECT conv_id || '-' || turn AS comment_id, CASE WHEN n % 13 <> 0 THEN text END AS text, CASE WHEN n % 3 = 1 THEN 'u' || (n % 50) END AS id, CASE WHEN n % 5 <> 0 THEN 'name' || (n % 20) END AS name,
  CASE WHEN n % 17 <> 0 THEN n % 19 = 0 END AS is_creator, turn FROM (SELECT *, conv_id * 7 + turn AS n FROM conversations))"""
_CLEAN = f"(SELECT *, coalesce(id, 'username:' || name) AS user_key FROM {_RAW} WHERE text IS NOT NULL AND is_creator IS NOT NULL AND NOT is_creator AND coalesce(name <> 'name3', true) AND coalesce(id <> 'u7', true) AND coalesce(id, name) IS NOT NULL)"


def _binding():
    return cleaning.Binding(required=("comment_id", "text"), creator_flag="is_creator", creator_names=frozenset({"Name3"}), creator_ids=frozenset({"u7"}), root=cleaning.is_root(F.col("parent_id")))


def clean_comments(spark, d):
    return cleaning.clean_comments(_raw_comments(spark, d), _binding()).select("comment_id", "user_key")


def clean_top_level(spark, d):
    out = cleaning.clean_comments(_raw_comments(spark, d), _binding(), top_level=True)
    return cleaning.at_least(out, ["user_key"], 3).groupBy("user_key").agg(F.count(F.lit(1)).alias("n"))


def rows_with_words(spark, d):
    """Documents without a word go; their number by source."""
    t = features.with_comment_features(docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit(" \n ")).otherwise(F.col("text"))))
    return cleaning.with_words(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))


def typed_values(spark, d):
    n = F.col("doc_id")
    raw = F.element_at(F.array(*map(F.lit, [" TRUE ", "1", "yes", "no", "0", "x"])), (n % 6 + 1).cast("int"))
    stamp = F.when(n % 4 == 0, "not a time").otherwise(F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00")))
    return docs(spark, d).select("doc_id", cleaning.as_bool(raw).alias("flag"), F.date_format(cleaning.as_timestamp(stamp), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def canonical_columns(spark, d):
    raw = docs(spark, d).select(F.col("doc_id").alias("VideoID"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("channel"), F.col("lang").alias("Language"))
    return cleaning.canonical(raw, {"id": ["video_id", "videoid"], "owner": ["channelTitle", "channel"], "lang": ["language"], "note": ["note"]}, ["id", "owner"])


def unique_column_names(spark, d):
    names = ["a", "b", "a", "a", "c", "b"]
    return spark.createDataFrame([(i, n) for i, n in enumerate(cleaning.unique_names(names))], "pos long, name string")


def text_flags(spark, d):
    """Links, mentions, mixed scripts, code fences and keywords put around the source's name."""
    n = F.col("doc_id")
    t = F.concat(F.when(n % 2 == 0, "  @ann ").otherwise("to "), F.lit("see https://a.b/c  "), F.when(n % 3 == 0, "é ").otherwise(""), "source", F.lit(f" {GRIN}"), F.when(n % 5 == 0, " #ad").otherwise(""))
    fenced = F.concat(F.lit("```json\n{\"s\": \""), "source", F.lit("\"}\n```"))
    flags = T.comment_flags(t)
    return docs(spark, d).select("doc_id", *[c.alias(k) for k, c in flags.items()], T.without_fences(fenced).alias("bare"), T.without_fences(fenced, 4).alias("preview"), T.label_key(F.concat(F.lit("A b-"), "source")).alias("label_key"), T.sponsored(t).alias("sponsored"), T.needs_check(t, n % 4 * 0.25, "#ad").alias("needs_check"))


def one_to_one_labels(spark, d):
    return selection.one_to_one(docs(spark, d).select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


def side_by_side(spark, d):
    """Counts of three subsets of orders a customer, whichever of them have any."""
    o = table(spark, d, "orders")
    part = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(f"n_{s.lower()}"))
    return selection.side_by_side([part("F"), part("O"), part("P")], "o_custkey")


def mapped_values(spark, d):
    return selection.mapped(docs(spark, d).select("doc_id", "lang"), "lang", {"en": 1, "de": 2, "it": 3}, "lang_no", 0)


def matched_folders(spark, d):
    names = table(spark, d, "pages").filter("page_id % 4 = 0").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit("_x")).alias("name"))
    urls = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://v.w/"), F.lit("f"), F.col("page_id").cast("string"), F.lit("_x/watch")).alias("url"))
    return selection.match_folders(urls, names).select("page_id", "folder")


def numbered_orders(spark, d):
    return selection.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx")


def suffixed_context(spark, d):
    """Turns with the document of the same number beside them, under names with a suffix."""
    t = turns(spark, d).select("comment_id", "media_id")
    return selection.with_context(t, docs(spark, d).withColumnRenamed("doc_id", "media_id"), "media_id", {"lang": "lang", "source": "origin"}, "_post")


def reconciled_prices(spark, d):
    """Total against parts, where every seventh part isn't known."""
    li = table(spark, d, "lineitem").select((F.col("l_quantity") + F.col("l_linenumber")).alias("total"), F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_linenumber")).alias("b"))
    return rounded(quality.describe(quality.reconcile(li, "total", ["a", "b"]), "difference"), 6)


def difference_counts(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_quantity") + F.col("l_linenumber")).alias("total"), F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_linenumber")).alias("b"))
    return quality.value_counts(quality.reconcile(li, "total", ["a", "b"]).select(F.col("difference").cast("long").alias("difference")), "difference")


def status_crosstab(spark, d):
    return quality.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


def label_changes(spark, d):
    l = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("base"), F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("final"), (F.col("doc_id") % 3 == 0).alias("called"))  # noqa: E741
    return rounded(quality.label_changes(l, "base", "final", F.col("called")))


def value_quantiles(spark, d):
    """Quantiles of each order status' prices, from counts by ranges."""
    return rounded(quality.quantiles(table(spark, d, "orders"), "o_totalprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["o_orderstatus"]), 6)


def centroid_medians(spark, d):
    """Medians of each class's metrics in each era."""
    m = classified(spark, d)
    return rounded(levels.group_quantiles(m, ["recency_class", "era"], ["recency", "engagement"], [0.5]))


def profile_distances(spark, d):
    """Manhattan distances between the distinct class vectors: at most 3**features of them."""
    p = levels.compress(classified(spark, d), FEATURES).orderBy(*FEATURES).toPandas()
    dist = kmedoids.manhattan(p[list(FEATURES)].to_numpy(float))
    names = ["-".join(str(v) for v in row) for row in p[list(FEATURES)].to_numpy().tolist()]
    return spark.createDataFrame([(names[i], names[j], float(dist[i, j])) for i in range(len(names)) for j in range(len(names))], "a string, b string, distance double")


def _weighted_profiles(spark, d):
    """The distinct class vectors and their weights: at most 3**features rows."""
    p = levels.compress(classified(spark, d), FEATURES).orderBy(*FEATURES).toPandas()
    return p, p[list(FEATURES)].to_numpy(float), p["weight"].to_numpy(float)


def medoid_costs(spark, d):
    """Cost of the best one, two and three medoids, by exchange and by alternation. The SQL tries all sets of medoids."""
    _, points, w = _weighted_profiles(spark, d)
    rows = [(k, kmedoids.pam(points, w, k).cost, kmedoids.alternating(points, w, k).cost) for k in (1, 2, 3)]
    return rounded(spark.createDataFrame(rows, "k int, exchanged double, alternated double"), 6)


def profile_silhouette(spark, d):
    """Weighted silhouette of the profiles clustered by their first class."""
    p, points, w = _weighted_profiles(spark, d)
    return rounded(spark.createDataFrame([(len(w), kmedoids.silhouette(kmedoids.manhattan(points), w, p[FEATURES[0]].to_numpy()))], "profiles int, silhouette double"))


def truncated_vectors(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", similarity.truncated(F.col("embedding"), 8).alias("v")).select("vec_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("v", F.lit(0)).alias("first")), 6)


QUERY_VECTOR = [((i * 29) % 13 - 6) / 10 for i in range(64)]


def embedding_distances(spark, d):
    return rounded(similarity.nearest(table(spark, d, "embeddings"), QUERY_VECTOR, 10, "vec_id", "embedding"), 7)


def merged_chunks(spark, d):
    """Turns as results of a conversation's chunks."""
    t = turns(spark, d).select("media_id", "turn", (F.col("turn") * 0.1).alias("polarization"), (F.col("turn") % 2 * 0.5).alias("visual_ratio"), F.col("author_id").alias("emotion"), F.array(F.concat(F.lit("P"), (F.col("turn") % 3).cast("string")), "author_id").alias("phrases"))
    return rounded(features.merge_chunks(t, "media_id", "turn", 3).withColumn("phrases", F.array_join("phrases", ",")))


def approved_labels(spark, d):
    names = selection.approved({"status": "approved", "labels": ["a", "b"]})
    return spark.createDataFrame([(n,) for n in names], "label string")


_DESC = "count(x)::BIGINT AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max"
_DIFF = "SELECT (l_quantity + l_linenumber - l_quantity - CASE WHEN l_linenumber % 7 <> 0 THEN l_linenumber ELSE 0 END)::DOUBLE AS x FROM lineitem"
_KEY = "concat_ws('-', " + ", ".join(FEATURES) + ")"
_PF = f"{CLASSIFIED}, pf AS (SELECT {', '.join(FEATURES)}, row_number() OVER (ORDER BY {', '.join(FEATURES)}) AS i, count(*)::DOUBLE AS w FROM k GROUP BY {', '.join(FEATURES)}), ds AS (SELECT x.i AS a, y.i AS b, x.{FEATURES[0]} AS la, x.w AS wa, y.{FEATURES[0]} AS l, y.w AS w, (" + " + ".join(f"abs(x.{f} - y.{f})" for f in FEATURES) + ")::DOUBLE AS d FROM pf x CROSS JOIN pf y)"
QUERIES: dict[str, Query] = {
    "emoji_cases": (emoji_cases, "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {r}::BIGINT, {w}::BIGINT, {u}::INT)" for i, (_, r, w, u) in enumerate(EMOJI_CASES)) + ") v(case_no, runs, words, units)"),
    "comment_emoji_features": (comment_emoji_features, rounded_sql(f"--main SELECT comment_id, word_count, emoji_count, unique_emoji_count, emoji_entropy, emoji_variety_ratio, emoji_per_word_ratio FROM {_EMOJI}", "emoji_entropy", "emoji_variety_ratio", "emoji_per_word_ratio")),
    "media_emoji_features": (
        media_emoji_features,
        rounded_sql(f"""--main SELECT media_id, count(*)::BIGINT AS comment_volume, count(DISTINCT author_id)::BIGINT AS unique_authors, avg((reply_to IS NOT NULL)::INT) AS reply_ratio, avg(word_count) AS mean_word_count, avg(emoji_per_word_ratio) AS mean_emoji_per_word, avg(emoji_entropy) AS mean_emoji_entropy,
        avg(emoji_variety_ratio) AS mean_emoji_variety, avg(has_links) AS link_ratio, avg((question_count > 0)::INT) AS interrogative_ratio, avg((exclamation_count > 0)::INT) AS exclamatory_ratio, avg((mention_count > 0)::INT) AS mention_ratio, avg((hashtag_count > 0)::INT) AS hashtag_ratio,
        1 - count(DISTINCT author_id)::DOUBLE / count(*) AS author_concentration FROM {_EMOJI} GROUP BY media_id""",
        "reply_ratio", "mean_word_count", "mean_emoji_per_word", "mean_emoji_entropy", "mean_emoji_variety", "link_ratio", "interrogative_ratio", "exclamatory_ratio", "mention_ratio", "hashtag_ratio", "author_concentration"),
    ),
    "user_emoji_matrix": (user_emoji_matrix, rounded_sql(f"--main SELECT author_id, platform, avg(emoji_count) AS mean_emoji_count, avg(unique_emoji_count) AS mean_unique_emoji_count, avg(emoji_count) / greatest(avg(word_count), 1) AS emoji_usage_rate FROM {_EMOJI} GROUP BY 1, 2", "mean_emoji_count", "mean_unique_emoji_count", "emoji_usage_rate")),
    "emoji_categories": (emoji_categories, "SELECT doc_id, 1 AS love, 2 AS humor, 1 AS inquiry, 0 AS celebration, 1 AS other FROM documents"),
    "emoji_names": (emoji_names, "SELECT doc_id, 'é ' || lang || ' :grinning_face::thumbs_up_sign_emoji_modifier_fitzpatrick_type_4:' AS named FROM documents"),
    "clean_comments": (clean_comments, f"SELECT comment_id, user_key FROM {_CLEAN}"),
    "clean_top_level": (clean_top_level, f"SELECT user_key, count(*)::BIGINT AS n FROM {_CLEAN} WHERE turn = 0 GROUP BY 1 HAVING count(*) >= 3"),
    "rows_with_words": (rows_with_words, f"SELECT source, count(*)::BIGINT AS n, sum(n)::BIGINT AS words FROM (SELECT source, len({_WORDS.format(t='text')}) AS n FROM documents WHERE doc_id % 9 <> 0) WHERE n > 0 GROUP BY 1"),
    "typed_values": (typed_values, "SELECT doc_id, doc_id % 6 < 3 AS flag, CASE WHEN doc_id % 4 <> 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' END AS stamp FROM documents"),
    "canonical_columns": (canonical_columns, "SELECT doc_id AS id, source AS owner, lang, NULL::VARCHAR AS note FROM documents WHERE doc_id % 5 <> 0 AND source IS NOT NULL"),
    "unique_column_names": (unique_column_names, "SELECT * FROM (VALUES (0::BIGINT, 'a'), (1, 'b'), (2, 'a_1'), (3, 'a_2'), (4, 'c'), (5, 'b_1')) v(pos, name)"),
    "text_flags": (
        text_flags,
        """WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN '@ann' ELSE 'to' END || ' see ' || CASE WHEN doc_id % 3 = 0 THEN 'é ' ELSE '' END || source AS body, CASE WHEN doc_id % 5 = 0 THEN ' #ad' ELSE '' END AS ad FROM documents)
        SELECT doc_id, body || ' 😀' || ad AS text_cleaned, body || ad AS text_no_emoji, doc_id % 2 = 0 AS is_reply_text, true AS has_multiple_scripts, '{"s": "' || source || '"}' AS bare, '{"s"' AS preview, 'ab' || regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS label_key,
        doc_id % 5 = 0 AS sponsored, doc_id % 4 < 3 OR doc_id % 5 = 0 AS needs_check FROM t""",
    ),
    "one_to_one_labels": (one_to_one_labels, "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "side_by_side": (side_by_side, "SELECT o_custkey, " + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0)::BIGINT AS n_{s.lower()}" for s in "FOP") + " FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1"),
    "mapped_values": (mapped_values, "SELECT doc_id, lang, coalesce(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'it' THEN 3 END, 0)::BIGINT AS lang_no FROM documents"),
    "matched_folders": (matched_folders, "SELECT u.page_id, min('f' || f.page_id || '_x') AS folder FROM pages u LEFT JOIN pages f ON f.page_id % 4 = 0 AND f.page_id = u.page_id GROUP BY 1"),
    "numbered_orders": (numbered_orders, "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS idx FROM orders"),
    "suffixed_context": (suffixed_context, f"SELECT comment_id, media_id, lang AS lang_post, source AS origin_post FROM {_TURNS} LEFT JOIN documents ON doc_id = media_id"),
    "reconciled_prices": (reconciled_prices, rounded_sql(f"--main SELECT {_DESC} FROM ({_DIFF})", "mean", "std", "min", "p25", "p50", "p75", "max", digits=6)),
    "difference_counts": (difference_counts, f"SELECT x::BIGINT AS value, count(*)::BIGINT AS n FROM ({_DIFF}) GROUP BY 1 ORDER BY n DESC, value LIMIT 10"),
    "status_crosstab": (status_crosstab, "SELECT o_orderpriority, " + ", ".join(f"""count(*) FILTER (o_orderstatus = '{s}')::BIGINT AS "{s}" """ for s in "FOPX") + " FROM orders GROUP BY 1"),
    "label_changes": (label_changes, rounded_sql("--main SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS base, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'fine' END AS final, count(*)::BIGINT AS n, avg((doc_id % 3 = 0)::INT) AS called FROM labels GROUP BY 1, 2", "called")),
    "value_quantiles": (value_quantiles, rounded_sql("--main SELECT o_orderstatus, quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1", "p10", "p50", "p99", digits=6)),
    "centroid_medians": (centroid_medians, rounded_sql(f"{CLASSIFIED} --main SELECT recency_class, era, quantile_cont(recency, 0.5) AS recency_p50, quantile_cont(engagement, 0.5) AS engagement_p50 FROM k GROUP BY 1, 2", "recency_p50", "engagement_p50")),
    "profile_distances": (profile_distances, f"{CLASSIFIED}, pf AS (SELECT DISTINCT {', '.join(FEATURES)}, {_KEY} AS name FROM k) SELECT x.name AS a, y.name AS b, (" + " + ".join(f"abs(x.{f} - y.{f})" for f in FEATURES) + ")::DOUBLE AS distance FROM pf x CROSS JOIN pf y"),
    "medoid_costs": (
        medoid_costs,
        rounded_sql(f"""{_PF}, c1 AS (SELECT a, sum(w * d) AS cost FROM ds GROUP BY a), c2 AS (SELECT p.a, q.a AS b, sum(p.w * least(p.d, q.d)) AS cost FROM ds p JOIN ds q ON p.b = q.b AND p.a < q.a GROUP BY 1, 2),
        c3 AS (SELECT p.a, q.a AS b, r.a AS c, sum(p.w * least(p.d, q.d, r.d)) AS cost FROM ds p JOIN ds q ON p.b = q.b AND p.a < q.a JOIN ds r ON r.b = q.b AND q.a < r.a GROUP BY 1, 2, 3), pm AS (SELECT 1 AS k, min(cost) AS cost FROM c1 UNION ALL SELECT 2, min(cost) FROM c2 UNION ALL SELECT 3, min(cost) FROM c3)
        --main SELECT k::INT AS k, cost AS exchanged, cost AS alternated FROM pm""", "exchanged", "alternated", digits=6),
    ),
    "profile_silhouette": (
        profile_silhouette,
        rounded_sql(f"""{_PF}, pmass AS (SELECT l, sum(w) AS m FROM (SELECT DISTINCT b, l, w FROM ds) GROUP BY 1), psum AS (SELECT a, la, wa, l, sum(w * d) AS s FROM ds GROUP BY 1, 2, 3, 4), pt AS (SELECT psum.*, pmass.m FROM psum JOIN pmass USING (l)),
        pu AS (SELECT a, any_value(wa) AS w, max(CASE WHEN l = la AND m > 1 THEN s / (m - 1) END) AS x, min(CASE WHEN l <> la THEN s / m END) AS y FROM pt GROUP BY a)
        --main SELECT count(*)::INT AS profiles, sum(w * CASE WHEN x IS NULL OR greatest(x, y) = 0 THEN 0 ELSE (y - x) / greatest(x, y) END)::DOUBLE / sum(w) AS silhouette FROM pu""", "silhouette"),
    ),
    "truncated_vectors": (truncated_vectors, rounded_sql("WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS h FROM embeddings), n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS s FROM v) --main SELECT vec_id, CASE WHEN s > 0 THEN list_sum(h) / s ELSE 0 END AS total, CASE WHEN s > 0 THEN h[1] / s ELSE 0 END AS \"first\" FROM n", "total", '"first"', digits=6)),
    "embedding_distances": (embedding_distances, rounded_sql(f"WITH q AS (SELECT [{', '.join(str(x) for x in QUERY_VECTOR)}]::DOUBLE[] AS q), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q), t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10) --main SELECT vec_id, 1 - score AS distance FROM t", "distance", digits=7)),
    "merged_chunks": (merged_chunks, rounded_sql(f"WITH t AS {_TURNS}, p AS (SELECT DISTINCT media_id, unnest(['p' || (turn % 3), lower(author_id)]) AS p FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY p) AS rn FROM p), s AS (SELECT media_id, string_agg(p, ',' ORDER BY p) AS phrases FROM r WHERE rn <= 3 GROUP BY 1) --main SELECT t.media_id, avg(turn * 0.1::DOUBLE) AS polarization, avg(turn % 2 * 0.5::DOUBLE) AS visual_ratio, arg_min(author_id, turn) AS emotion, any_value(phrases) AS phrases FROM t JOIN s USING (media_id) GROUP BY 1", "polarization", "visual_ratio")),
    "approved_labels": (approved_labels, "SELECT * FROM (VALUES ('a'), ('b')) v(label)"),
}
