"""The same person under several names: exact, then fuzzy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import let


def clean_name(c: Column) -> Column:
    """Lower case without emoji, white space one space."""
    c = F.regexp_replace(F.lower(c), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0E}\x{FE0F}\x{200D}]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def indel_ratio(a: str, b: str) -> float:
    """200 * (longest common subsequence) / (both lengths): 100 for equal strings."""
    if not a and not b:
        return 100.0
    # Bit-parallel: bit i of `free` is cleared once a[i] is matched.
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def exact_matches(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """a_id, b_id, score 100 for equal names (columns: id, name)."""
    x, y = a.select(F.col("id").alias("a_id"), F.col(name).alias("im_a")), b.select(F.col("id").alias("b_id"), F.col(name).alias("im_b"))
    return x.join(y, F.col("im_a") == F.col("im_b")).select("a_id", "b_id", F.lit(100.0).alias("score"))


def fuzzy_matches(a: DataFrame, b: DataFrame, name: str = "name", threshold: float = 85.0) -> DataFrame:
    """a_id, b_id, score: for each name of a without an equal in b, the best of b by indel ratio if at least threshold.

    Names of n and m characters with that ratio share at least 1 + (n + m)(1.5 t - 1) pairs of neighbours (t the
    threshold by 100, 2/3 at least): an unmatched character breaks two of its own name's or one of the other's. So among the
    rarest pairs of each, all but so many less one, the two must meet. Of the n characters at most n - t (n + m) / 2 are not in the other
    name; bits of 64 for the characters and for the pairs show some that are not, before names are compared one by one.
    Each distinct name is compared once, whatever the number of its rows. Ties go to the smaller b_id.
    """
    t = threshold / 100
    if t < 2 / 3:
        raise ValueError("thresholds below 66.7 would need all pairs")
    x = a.select(F.col("id").alias("a_id"), F.col(name).alias("x")).filter(F.length("x") > 0)
    y = b.select(F.col("id").alias("b_id"), F.col(name).alias("y")).filter(F.length("y") > 0)
    named = y.groupBy("y").agg(F.min("b_id").alias("b_id"))
    rest = x.select("x").distinct().join(named.select("y"), F.col("x") == F.col("y"), "left_anti")
    # Pairs of neighbours, the ends included, each with the number of its earlier occurrences: sets, not bags. So are the characters.
    two = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(F.concat(F.lit("\x02"), F.col(c), F.lit("\x03")), i, F.lit(2)))
    one = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(F.col(c), i, F.lit(1)))
    numbered = lambda parts: let(parts, lambda gs: F.transform(gs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(gs, 1, i), lambda h: h == g)).cast("string"))))
    bits = lambda gs: F.aggregate(gs, F.lit(0).cast("long"), lambda z, g: z.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))
    parts = lambda df, c, *more: df.select(c, *more, numbered(two(c)).alias("gs"), bits(numbered(one(c))).alias(f"{c}1")).select(c, *more, f"{c}1", bits(F.col("gs")).alias(f"{c}2"), F.explode("gs").alias("g"))
    gy = parts(named, "y", "b_id")
    known = gy.groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    # With a number given, the few rows are not gathered into one task.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rarest(df: DataFrame, c: str, *more: str) -> DataFrame:
        n = F.length(c)
        shared = F.ceil(1 + (n + F.ceil(t * n / (2 - t) - 1e-9)) * (1.5 * t - 1) - 1e-9)
        counted = df.join(known, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        return counted.withColumn("r", F.row_number().over(W.partitionBy(c).orderBy("df", "g"))).filter(F.col("r") <= n + 1 - shared + 1).select("g", c, f"{c}1", f"{c}2", *more).repartition(tasks, "g")

    n, m = F.length("x"), F.length("y")
    near = (m >= F.ceil(t * n / (2 - t) - 1e-9)) & (m <= F.floor(n * (2 - t) / t + 1e-9))
    lacks = lambda p, q: F.bit_count(F.col(p).bitwiseAND(F.bitwise_not(q)))
    common, shared = t * (n + m) / 2 - 1e-9, 1 + (n + m) * (1.5 * t - 1) - 1e-9
    near &= (lacks("x1", "y1") <= n - common) & (lacks("y1", "x1") <= m - common) & (lacks("x2", "y2") <= n + 1 - shared) & (lacks("y2", "x2") <= m + 1 - shared)
    gx = rarest(parts(rest, "x"), "x")
    pairs = gx.join(rarest(gy, "y", "b_id"), "g").filter(near).select("x", "b_id", "y").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([indel_ratio(p, q) for p, q in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], names=["x", "b_id", "score"])

    kind = pairs.schema["b_id"].dataType.simpleString()
    scored = pairs.mapInArrow(run, f"x string, b_id {kind}, score double").filter(F.col("score") >= threshold)
    first = lambda df, key: df.groupBy(key).agg(F.min_by(F.struct("b_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("b_id"))).alias("m")).select(key, "m.b_id", "m.score")
    return first(x.join(first(scored, "x"), "x"), "a_id")
