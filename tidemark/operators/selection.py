"""Which rows: platforms, years, samples, preferred records, what is still missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import let


def on_platforms(df: DataFrame, names: Sequence[str], platform: str = "platform") -> DataFrame:
    return df.filter(F.lower(F.col(platform)).isin(*[n.lower() for n in names]))


def in_years(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    """A range on the column itself, so the scan can skip by its statistics."""
    return df.filter((F.col(ts) >= F.lit(f"{first}-01-01").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz")))


def split_kinds(df: DataFrame, is_short: str = "is_short") -> tuple[DataFrame, DataFrame]:
    """Shorts and long videos; an unknown kind is in neither."""
    return df.filter(F.col(is_short)), df.filter(~F.col(is_short))


def missing_from(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def known_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def prefer(df: DataFrame, key: str, better: Sequence[Column]) -> DataFrame:
    """One row a key, the first by `better`; of the rows without a key the first one, found without gathering them."""
    none = df.filter(F.col(key).isNull()).orderBy(*better).limit(1)
    df = df.filter(F.col(key).isNotNull())
    return none.unionByName(df.withColumn("se_n", F.row_number().over(W.partitionBy(key).orderBy(*better))).filter("se_n = 1").drop("se_n"))


def sample_with_top_up(df: DataFrame, n: int, by: str, key: str, seed: int = 42) -> DataFrame:
    """n rows, evenly by stratum as far as they go, the rest from all others, in hash order. n is the feature's size."""
    order = [F.xxhash64(key, F.lit(seed)), F.col(key)]
    ranked = df.withColumn("se_n", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    strata = df.select(by).distinct().agg(F.count(F.lit(1)).alias("se_k"))
    share = F.floor(F.lit(n) / F.greatest(F.col("se_k"), F.lit(1)))
    rows = ranked.crossJoin(F.broadcast(strata)).withColumn("se_late", (F.col("se_n") > share).cast("int"))
    return rows.orderBy("se_late", *order).limit(n).drop("se_n", "se_k", "se_late")


def latest_per_group(df: DataFrame, by: str, ts: str, k: int, tie: str) -> DataFrame:
    return df.withColumn("se_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(ts), tie))).filter(F.col("se_n") <= k).drop("se_n")


def era_order(df: DataFrame, era: str, start: str) -> DataFrame:
    """era, era_index by its earliest start. The window runs over eras."""
    first = df.groupBy(era).agg(F.min(start).alias("se_first"))
    return first.select(era, F.row_number().over(W.orderBy("se_first", era)).alias("era_index"))


def evenly_spaced(items: Column, k: int) -> Column:
    """k elements of an array at even distances, the ends included; all if there are no more."""
    at = lambda i, n: F.bround(i * (n - 1) / F.lit(max(k - 1, 1)), 0).cast("int")
    return let(items, lambda xs: F.when(F.size(xs) <= k, xs).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(xs, at(i, F.size(xs))))))


def unified(platforms: Mapping[str, tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """comment_id, author_id, media_id, text, reply_to, platform of several sources by their column maps; rows without author or medium go."""
    cols, out = ("comment_id", "author_id", "media_id", "text", "reply_to"), None
    for name, (df, names) in platforms.items():
        one = df.select(*[(F.col(names[c]).cast("string") if c in names else F.lit(None).cast("string")).alias(c) for c in cols], F.lit(name).alias("platform"))
        one = one.filter((F.trim("author_id") != "") & (F.trim("media_id") != ""))
        out = one if out is None else out.unionByName(one)
    return out


def one_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key, the least of its rows by their other columns, so a rerun keeps the same."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("se_row")).select(*[F.col(c) if c in keys else F.col(f"se_row.{c}") for c in df.columns])


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with right's columns, if no key repeats on either side; raises otherwise. A repeated key, if any, reaches the driver."""
    for name, side in (("left", left), ("right", right)):
        if (bad := side.groupBy(*keys).count().filter("count > 1").first()) is not None:
            raise ValueError(f"the {name} side has {bad['count']} rows for {', '.join(str(bad[k]) for k in keys)}")
    return left.join(right, list(keys), "left")


def side_by_side(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """All frames' columns in one row a key, whichever of them have it."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, key, "full")
    return out


def mapped(df: DataFrame, col: str, table: Mapping[object, object], out: str, default: object = None) -> DataFrame:
    """df with `out`: what a small table of constants has for the column's value. The table is broadcast, as it is part of the plan."""
    rows = df.sparkSession.createDataFrame(list(table.items()), [f"se_{col}", out])
    joined = df.join(F.broadcast(rows), F.col(col) == F.col(f"se_{col}"), "left").drop(f"se_{col}")
    return joined.withColumn(out, F.coalesce(out, F.lit(default))) if default is not None else joined


def numbered(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """df with a number from 0 in the given order. Rows are dealt to ranges, counted, and numbered within theirs, so no task sees them all."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*order)
    ends = df.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h", "k").limit(100 * parts).select("k").distinct().withColumn("n", F.ntile(parts).over(W.orderBy("k")))
    ends = ends.groupBy("n").agg(F.min("k").alias("k")).agg(F.array_sort(F.collect_list("k")).alias("se_ends"))  # one row of at most `parts` keys of a fixed-size sample
    dealt = df.crossJoin(F.broadcast(ends)).withColumn("se_part", F.size(F.filter("se_ends", lambda e: e <= key))).drop("se_ends")
    counts = dealt.groupBy("se_part").agg(F.count(F.lit(1)).alias("se_n")).select(F.col("se_part").alias("se_p"), F.coalesce(F.sum("se_n").over(W.orderBy("se_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("se_before"))
    inside = F.row_number().over(W.partitionBy("se_part").orderBy(*order)) - 1
    return dealt.withColumn("se_in", inside).join(F.broadcast(counts), F.col("se_part") == F.col("se_p")).withColumn(out, F.col("se_before") + F.col("se_in")).drop("se_part", "se_p", "se_before", "se_in")


def match_folders(urls: DataFrame, folders: DataFrame, url: str = "url", name: str = "name") -> DataFrame:
    """urls with `folder`: the first folder (by name) whose name stands anywhere in the url, else null.

    The folders' names have few lengths; each url's pieces of those lengths meet the names by equality, so no pairs of all with all form.
    """
    lengths = folders.filter(F.length(name) > 0).select(F.length(name).alias("n")).distinct().agg(F.collect_set("n").alias("se_lengths"))
    pieces = F.flatten(F.transform("se_lengths", lambda n: F.when(n <= F.length(url), F.transform(F.sequence(F.lit(1), F.length(url) - n + 1), lambda i: F.substring(F.col(url), i, n))).otherwise(F.array().cast("array<string>"))))
    cut = urls.select(F.col(url).alias("se_url")).distinct().crossJoin(F.broadcast(lengths)).withColumn(url, F.col("se_url")).select("se_url", F.explode(F.array_distinct(pieces)).alias("se_piece"))
    found = cut.join(folders.select(F.col(name).alias("se_name")).distinct(), F.col("se_piece") == F.col("se_name")).groupBy("se_url").agg(F.min("se_name").alias("folder"))
    return urls.join(found, F.col(url) == F.col("se_url"), "left").drop("se_url")


def with_context(comments: DataFrame, posts: DataFrame, key: str, columns: Mapping[str, str], suffix: str = "") -> DataFrame:
    """comments left joined to one row a key of posts; columns: their new names."""
    one = one_row(posts.select(F.col(key).alias("se_key"), *[F.col(c).alias(f"{n}{suffix}") for c, n in columns.items()]), ["se_key"])
    return comments.join(one, F.col(key) == F.col("se_key"), "left").drop("se_key")


def idempotent(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest result of each key."""
    return prefer(results.withColumn("se_key", F.struct(*keys)), "se_key", [F.desc(order)]).drop("se_key")


def approved(taxonomy: Mapping[str, object]) -> list[str]:
    """The labels of a taxonomy that may be used; raises otherwise."""
    if str(taxonomy.get("status", "")).upper() != "APPROVED" or not taxonomy.get("labels"):
        raise ValueError("the taxonomy is not approved or empty")
    return list(taxonomy["labels"])


def with_results(rows: DataFrame, results: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Every row once, with its label and confidence; where there is no result: ERROR and 0."""
    one = results.groupBy(*keys).agg(F.max(F.struct("confidence", label)).alias("se_r"))
    return one_row(rows, keys).join(one, list(keys), "left").select(*rows.columns, F.coalesce(f"se_r.{label}", F.lit("ERROR")).alias(label), F.coalesce("se_r.confidence", F.lit(0.0)).alias("confidence"))
