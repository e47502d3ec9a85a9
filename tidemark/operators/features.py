"""Comments to features of media and of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T

FLAGS = {"interrogative_ratio": "question_count", "exclamatory_ratio": "exclamation_count", "mention_ratio": "mention_count", "hashtag_ratio": "hashtag_count"}


def with_comment_features(df: DataFrame, text_col: str = "text", emoji_col: str | None = None) -> DataFrame:
    """df with the counts of each comment; emoji_col: an array of emoji units (none: no emoji columns)."""
    out = df.withColumns(T.comment_features(F.col(text_col)))
    return out.withColumns(T.emoji_features(F.col(emoji_col), F.col("word_count"))) if emoji_col else out


def media_features(comments: DataFrame, media: str = "media_id", author: str = "author_id", reply: str = "reply_to") -> DataFrame:
    """One row a medium: volume, authors and their concentration, share of replies, means and shares of the comment features."""
    have = set(comments.columns)
    means = {"mean_word_count": "word_count", "mean_emoji_per_word": "emoji_per_word_ratio", "mean_emoji_entropy": "emoji_entropy", "mean_emoji_variety": "emoji_variety_ratio", "link_ratio": "has_links"}
    out = comments.groupBy(media).agg(
        F.count(F.lit(1)).alias("comment_volume"), F.count_distinct(author).alias("unique_authors"), F.avg(F.col(reply).isNotNull().cast("double")).alias("reply_ratio"),
        *[F.avg(c).alias(n) for n, c in means.items() if c in have], *[F.avg((F.col(c) > 0).cast("double")).alias(n) for n, c in FLAGS.items() if c in have],
    )
    share = F.least(F.greatest(F.col("unique_authors") / F.col("comment_volume"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("author_concentration", 1 - share)


def user_matrix(comments: DataFrame, author: str = "author_id", platform: str = "platform") -> DataFrame:
    """One row for each author and platform: counts, means of the features, guarded rates."""
    have = set(comments.columns)
    cols = [c for c in ("text_length", "word_count", "emoji_count", "unique_emoji_count", "mention_count", "hashtag_count", "url_count", "has_links", "has_numbers") if c in have]
    out = comments.groupBy(author, platform).agg(F.count("comment_id").alias("total_comments"), F.count_distinct("media_id").alias("unique_posts_commented"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    rate = F.col("mean_emoji_count") / F.greatest(F.col("mean_word_count"), F.lit(1.0)) if "emoji_count" in have else F.lit(0.0)
    links = F.col("mean_has_links") * 100 if "has_links" in have else F.lit(0.0)
    ratio = F.least(F.col("unique_posts_commented") / F.greatest(F.col("total_comments"), F.lit(1)), F.lit(1.0))
    return out.withColumns({"emoji_usage_rate": rate, "link_inclusion_rate": links, "post_concentration_ratio": ratio})


def top_texts(comments: DataFrame, keys: list[str], order: str, tie: str, text_col: str = "text", k: int = 5, chars: int = 200, sep: str = " ||| ") -> DataFrame:
    """The k texts of largest `order`, each cut to `chars` characters: a feature of the report, as is their number."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order), tie))
    top = comments.withColumn("ft_n", rank).filter(F.col("ft_n") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ft_n", F.substring(text_col, 1, chars).alias("t")))), lambda x: x["t"]), sep)
    return top.groupBy(*keys).agg(joined.alias("top_texts"))


def vibe(comments: DataFrame, media: str, similarity: str) -> DataFrame:
    """comments, mean similarity and polarisation (population deviation / 0.5 within [0, 1]; 0.5 below two values)."""
    spread = F.least(F.greatest(F.stddev_pop(similarity) / 0.5, F.lit(0.0)), F.lit(1.0))
    return comments.groupBy(media).agg(F.count(similarity).alias("n_scored"), F.avg(similarity).alias("mean_similarity"), F.when(F.count(similarity) >= 2, spread).otherwise(0.5).alias("polarisation"))


def union_terms(df: DataFrame, key: str, terms: str, k: int = 15) -> DataFrame:
    """The first k terms, sorted, of all a key's arrays; sets are merged before they are gathered."""
    one = df.select(key, F.explode(terms).alias("ft_t")).distinct()
    rank = F.row_number().over(W.partitionBy(key).orderBy("ft_t"))
    return one.withColumn("n", rank).filter(F.col("n") <= k).groupBy(key).agg(F.array_sort(F.collect_list("ft_t")).alias("terms"))


def merge_chunks(results: DataFrame, key: str, order: str, k: int = 20) -> DataFrame:
    """One row a key of its chunks' results: means of the indices, the first chunk's emotion, and the first k of all phrases in lower case, sorted."""
    one = results.groupBy(key).agg(F.avg("polarization").alias("polarization"), F.avg("visual_ratio").alias("visual_ratio"), F.min_by("emotion", order).alias("emotion"))
    phrases = union_terms(results.select(key, F.transform("phrases", F.lower).alias("phrases")), key, "phrases", k).withColumnsRenamed({key: "ft_key", "terms": "phrases"})
    return one.join(phrases, F.col(key) == F.col("ft_key"), "left").drop("ft_key")


def sample_comments(df: DataFrame, media: str, is_reply: str, order: str, k: int) -> DataFrame:
    """k comments a medium, biased to top level: max(k // 2, k - replies) of those, as far as they go."""
    rank = F.row_number().over(W.partitionBy(media, is_reply).orderBy(order))
    counts = df.groupBy(F.col(media).alias("ft_m")).agg(F.count(F.when(~F.col(is_reply), 1)).alias("tops"), F.count(F.when(F.col(is_reply), 1)).alias("reps"))
    n_top = F.least(F.col("tops"), F.greatest(F.lit(k // 2), F.lit(k) - F.col("reps")))
    rows = df.withColumn("ft_n", rank).join(counts, F.col(media) == F.col("ft_m"))
    return rows.filter(F.when(F.col(is_reply), F.col("ft_n") <= F.lit(k) - n_top).otherwise(F.col("ft_n") <= n_top)).drop("ft_n", "ft_m", "tops", "reps")


def edges(comments: DataFrame, comment: str = "comment_id", author: str = "author_id", media: str = "media_id", reply: str = "reply_to") -> DataFrame:
    """src, dst, kind: author to medium, author to comment, comment to the one it answers."""
    pair = lambda a, b, kind: F.struct(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.lit(kind).alias("kind"))
    all_ = F.array(pair(author, media, "commented_on"), pair(author, comment, "wrote"), pair(comment, reply, "replies_to"))
    return comments.select(F.explode(all_).alias("e")).select("e.*").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
