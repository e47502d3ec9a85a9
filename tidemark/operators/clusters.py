"""Summaries of clusters, and clustering by Spark's own learners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def summary(profiles: DataFrame, features: Sequence[str], weight: str = "weight", cluster: str = "cluster") -> DataFrame:
    """Of weighted profiles: profiles, weight, share of each cluster, weighted means, and the heaviest profile with its share (the first on a tie)."""
    w = F.col(weight)
    total = profiles.agg(F.sum(w).alias("cu_total"))
    first = F.struct(*[(-F.col(f)).alias(f"n_{f}") for f in features])
    out = profiles.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("profiles"), F.sum(w).alias("weight"), *[(F.sum(w * F.col(f)) / F.sum(w)).alias(f"mean_{f}") for f in features],
        F.max_by(F.concat_ws("-", *features), F.struct(w.alias("w"), first.alias("f"))).alias("top_profile"), (F.max(w) / F.sum(w)).alias("top_share"),
    )
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("weight") / F.col("cu_total")).drop("cu_total")


def level_shares(df: DataFrame, metrics: Sequence[str], levels: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """cluster, metric, one share a level, dominant (the first of the levels that is most frequent)."""
    long = df.select(cluster, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("p")).select(cluster, "p.metric", "p.value")
    n = long.groupBy(cluster, "metric").agg(F.count("value").alias("cu_n"), *[F.count(F.when(F.col("value") == v, 1)).alias(f"cu_{v}") for v in levels])
    most: Column = F.greatest(*[F.col(f"cu_{v}") for v in levels])
    dominant = F.lit(None).cast("string")
    for v in reversed(levels):
        dominant = F.when(F.col(f"cu_{v}") == most, v).otherwise(dominant)
    return n.select(cluster, "metric", *[(F.col(f"cu_{v}") / F.nullif(F.col("cu_n"), F.lit(0))).alias(f"share_{v.lower()}") for v in levels], dominant.alias("dominant"))


def named(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str = "Mixed", out: str = "cluster_name") -> DataFrame:
    """The name of the first rule that holds."""
    name = F.lit(default)
    for cond, label in reversed(rules):
        name = F.when(cond, label).otherwise(name)
    return df.withColumn(out, name)


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, rounds: int = 50, starts: int = 1, labels: Mapping[int, int] | None = None) -> DataFrame:
    """df with `cluster` from 1, numbered in the order of the centres' first coordinates, then renamed by labels; columns are standardised first.

    Of `starts` seeds from `seed` on, the run of least cost counts.
    """
    scale = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="cu_raw"), StandardScaler(inputCol="cu_raw", outputCol="cu_x", withMean=True, withStd=True)]).fit(df)
    points = scale.transform(df).select("cu_x").cache()
    model = min((KMeans(featuresCol="cu_x", predictionCol="cu_c", k=k, seed=seed + i, maxIter=rounds).fit(points) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    points.unpersist()
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    rank = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(old), F.lit((labels or {}).get(new + 1, new + 1)))])
    return model.transform(scale.transform(df)).withColumn("cluster", rank[F.col("cu_c")]).drop("cu_raw", "cu_x", "cu_c")


def pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """df with pc_1.. of the centred columns; signs are those that make the largest loading positive."""
    stages = [VectorAssembler(inputCols=list(cols), outputCol="cu_raw"), StandardScaler(inputCol="cu_raw", outputCol="cu_x", withMean=True, withStd=False), PCA(k=k, inputCol="cu_x", outputCol="cu_p")]
    model = Pipeline(stages=stages).fit(df)
    loads = model.stages[-1].pc.toArray()
    signs = [1.0 if abs(loads[:, j].max()) >= abs(loads[:, j].min()) else -1.0 for j in range(k)]
    out = model.transform(df).withColumn("cu_a", vector_to_array("cu_p"))
    return out.withColumns({f"pc_{j + 1}": F.get("cu_a", F.lit(j)) * s for j, s in enumerate(signs)}).drop("cu_raw", "cu_x", "cu_p", "cu_a")


def rank_order(df: DataFrame, names: Sequence[str], col: str) -> DataFrame:
    """Rows in the order of a list of names; others last, by name."""
    rank = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(F.col(col) == n, i + 1).otherwise(rank)
    return df.withColumn("cu_rank", rank).orderBy(F.asc_nulls_last("cu_rank"), col).drop("cu_rank")


def argmax_rows(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    return df.withColumn("cu_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), tie))).filter("cu_n = 1").drop("cu_n")
