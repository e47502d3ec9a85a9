"""Cleaning of comments and posts: keys, filters, casts, fills. All are expressions that the scan can take over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .quality import quantiles


@dataclass(frozen=True)
class Binding:
    """How one platform's comments are read: names of columns and the rules that differ between platforms."""

    required: tuple[str, ...]
    id_col: str = "from_id"
    name_col: str = "from_username"
    prefix: str = "username"
    min_comments: int = 3
    creator_names: frozenset[str] = frozenset()
    creator_ids: frozenset[str] = frozenset()
    creator_flag: str | None = None
    root: Column | None = field(default=None)


def _trimmed(c: Column) -> Column:
    return F.nullif(F.btrim(c.cast("string"), F.lit(" \t\n\r\f\x0b")), F.lit(""))


def user_key(id_col: Column, name_col: Column, prefix: str) -> Column:
    """The trimmed id, else prefix:name in lower case. Unlike full case folding, lower() leaves a sharp s as it is."""
    return F.coalesce(_trimmed(id_col), F.concat(F.lit(f"{prefix}:"), F.lower(_trimmed(name_col))))


def not_creator(b: Binding) -> Column:
    """A row whose flag is null goes, as it is not known to be somebody else's."""
    keep = F.lit(True)
    if b.creator_flag:
        keep &= F.col(b.creator_flag) != True  # noqa: E712  null stays null, so the filter drops it
    if b.creator_names:
        keep &= ~F.coalesce(F.lower(_trimmed(F.col(b.name_col))).isin(*[n.lower() for n in b.creator_names]), F.lit(False))
    if b.creator_ids:
        keep &= ~F.coalesce(_trimmed(F.col(b.id_col)).isin(*b.creator_ids), F.lit(False))
    return keep


def is_root(parent: Column, *others: Column, sentinel: str | None = None) -> Column:
    """A comment that answers none. With a sentinel the parent must equal it; numbers count 0 and null as none."""
    if sentinel is not None:
        return parent == sentinel
    out = F.lit(True)
    for c in (parent, *others):
        out &= F.coalesce(c.cast("string"), F.lit("0")).isin("0", "", "false")
    return out


def clean_comments(df: DataFrame, b: Binding, top_level: bool = False) -> DataFrame:
    df = df.dropna(subset=list(b.required)).filter(not_creator(b))
    if top_level and b.root is not None:
        df = df.filter(b.root)
    return df.withColumn("user_key", user_key(F.col(b.id_col), F.col(b.name_col), b.prefix)).filter(F.col("user_key").isNotNull())


def with_words(df: DataFrame, words: str = "word_count") -> DataFrame:
    """Rows with one word or more; an unknown count goes."""
    return df.filter(F.col(words) > 0)


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with n rows or more; counts are pre-aggregated, so a hot group isn't gathered."""
    groups = df.groupBy(*keys).count().filter(F.col("count") >= n).drop("count")
    return df.join(groups, list(keys), "left_semi")


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "t")


def as_timestamp(c: Column) -> Column:
    """Null where it can't be read."""
    return F.try_to_timestamp(c.cast("string"))


def fill(df: DataFrame, constants: Mapping[str, object], medians: Sequence[str] = ()) -> DataFrame:
    """Nulls become constants, or the column's exact median (one row, joined to all)."""
    df = df.fillna({k: v for k, v in constants.items()})
    if medians:
        mid = None
        for c in medians:
            one = quantiles(df, c, {f"cl_{c}": 0.5})
            mid = one if mid is None else mid.crossJoin(one)  # one row each
        df = df.crossJoin(F.broadcast(mid)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"cl_{c}")) for c in medians}).drop(*[f"cl_{c}" for c in medians])
    return df


def canonical(df: DataFrame, names: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Each column from the first of its candidates that is there, else null; rows without the required ones go."""
    have = {c.lower(): c for c in df.columns}
    picked = [next((F.col(f"`{have[c.lower()]}`") for c in cands if c.lower() in have), F.lit(None).cast("string")).alias(out) for out, cands in names.items()]
    return df.select(*picked).dropna(subset=list(required) or None, how="any" if required else "all")


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(n if n not in seen else f"{n}_{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("cl_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("cl_n = 1").drop("cl_n")


def without_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def content_format(ts: Column, seconds: Column, carousel: Column) -> Column:
    """The platform's video formats changed on 2021-10-05 and 2022-07-21; a feed video had up to 60.121 s."""
    first, second = F.lit("2021-10-05").cast("timestamp_ntz"), F.lit("2022-07-21").cast("timestamp_ntz")
    return (
        F.when((ts < first) & (seconds <= 60.121), "Standard Feed Video")
        .when((ts < first) & (seconds > 60.121), "IGTV")
        .when((ts >= first) & (ts < second), "Instagram Video Merge")
        .when((ts >= second) & carousel & (seconds <= 60), "Feed Carousel Video")
        .when((ts >= second) & ~carousel, "Reel")
        .otherwise("Unclassified")
    )


def stratified_sample(df: DataFrame, by: str, share: float, key: Column, seed: int = 42, least: int = 1) -> DataFrame:
    """max(least, floor(rows * share)) rows of each stratum, in the order of a hash of the key: a rerun takes the same."""
    w = W.partitionBy(by)
    size = df.groupBy(by).agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(least)).alias("cl_take"))
    ranked = df.withColumn("cl_n", F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key)))
    return ranked.join(size, by).filter(F.col("cl_n") <= F.col("cl_take")).drop("cl_n", "cl_take")


def fixed_sample(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def split_evenly(df: DataFrame, parts: int, n: int, key: Column, seed: int = 42) -> DataFrame:
    """A sample of n rows in `parts` chunks of equal size, the rest in the last; the chunk is column `part` from 0."""
    picked = fixed_sample(df, n, key, seed)
    # The window runs over the sample alone, whose size is the feature.
    at = F.row_number().over(W.orderBy(F.xxhash64(key, F.lit(seed)), key)) - 1
    size = max(1, n // parts)
    return picked.withColumn("part", F.least(F.floor(at / size), F.lit(parts - 1)).cast("int"))
