"""Vectors and sets: cosine, overlap, topic affinity, nearest embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """`zero` where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(F.lit(zero))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets have none."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by the size of the first."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def truncated(v: Column, dims: int) -> Column:
    """The first dims coordinates, brought to length 1 again."""
    unit = lambda h, size: F.transform(h, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
    return let(F.slice(v, 1, dims), lambda h: F.get(F.transform(F.array(F.sqrt(dot(h, h))), lambda size: unit(h, size)), F.lit(0)))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vec_col: str) -> DataFrame:
    """The k rows nearest to a constant vector by cosine; each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vec_col: str) -> DataFrame:
    """The k rows of least cosine distance (1 - cosine), ties by id."""
    return top_k(vectors, query, k, id_col, vec_col).select(id_col, (1 - F.col("score")).alias("distance"))


def topic_vectors(weights: DataFrame, owner: str, topic: str, weight: str, topics: Sequence[str], strict: bool = False) -> DataFrame:
    """owner, topic, share: weights summed by topic over the whole universe of topics, zero where there is none, to a sum of 1.

    A vector whose weights sum to zero has null shares; with strict it stops the query.
    """
    sums = weights.filter(F.col(topic).isin(*topics)).groupBy(owner, topic).agg(F.sum(weight).alias("w"))
    grid = weights.select(owner).distinct().select(owner, F.explode(F.array(*[F.lit(t) for t in topics])).alias(topic))
    total = F.sum("w").over(W.partitionBy(owner))
    vectors = grid.join(sums, [owner, topic], "left").fillna(0.0, ["w"]).withColumn("total", total)
    empty = F.raise_error(F.concat(F.lit("no weight at all for "), F.col(owner).cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return vectors.select(owner, topic, F.when(F.col("total") == 0, empty).otherwise(F.col("w") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"))


def affinity(vectors: DataFrame, owner: str, topic: str, base: str) -> DataFrame:
    """owner, affinity: cosine to the base owner's topic vector; null if a vector is empty."""
    reference = vectors.filter(F.col(owner) == base).select(F.col(topic).alias("sm_topic"), F.col("share").alias("sm_share"))
    joined = vectors.join(F.broadcast(reference), F.col(topic) == F.col("sm_topic"))  # a row a topic
    size = F.sqrt(F.sum(F.col("share") * F.col("share"))) * F.sqrt(F.sum(F.col("sm_share") * F.col("sm_share")))
    return joined.groupBy(owner).agg((F.sum(F.col("share") * F.col("sm_share")) / F.nullif(size, F.lit(0.0))).alias("affinity")).filter(F.col(owner) != base)
