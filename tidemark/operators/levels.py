"""Cut points, levels and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import quantiles

LEVELS = ("Low", "Medium", "High")


def two_cut(v: Column, t1: Column | float, t2: Column | float) -> Column:
    """1 up to t1, 2 up to t2, 3 above; null stays null."""
    return F.when(v <= t1, 1).when(v <= t2, 2).when(v > t2, 3)


def three_levels(v: Column, low: Column | float, high: Column | float, strict: bool = False, missing: str | None = "High", names: Sequence[str] = LEVELS) -> Column:
    """Low up to `low` (below it if strict), High above `high` (from it on if strict); missing: the level of a null."""
    under = (v < low, v < high) if strict else (v <= low, v <= high)
    named = F.when(under[0], names[0]).when(under[1], names[1]).otherwise(names[2])
    return F.when(v.isNull(), F.lit(missing)).otherwise(named)


def profile(parts: Mapping[str, Column]) -> Column:
    """R=Low | F=Medium | E=High"""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), c) for k, c in parts.items()])


def group_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], at: Sequence[float], digits: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles: {col}_p{100 * q}, rounded half to even if digits are given. All columns go through one pass over counts of values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("lv_m"), F.col(c).cast("double").alias("lv_v")) for c in cols])).alias("lv")
    names = {f"p{round(q * 100)}": q for q in at}
    found = quantiles(df.select(*by, cells).select(*by, "lv.*"), "lv_v", names, [*by, "lv_m"])
    value = lambda n: F.bround(F.col(n), digits) if digits is not None else F.col(n)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("lv_m") == c, value(n))).alias(f"{c}_{n}") for c in cols for n in names])


def check_thresholds(table: DataFrame, metrics: Sequence[str], key: str = "metric") -> DataFrame:
    """The table, if each metric has exactly one row; a metric a row reaches the driver."""
    have = {r[0]: r[1] for r in table.filter(F.col(key).isin(*metrics)).groupBy(key).count().collect()}
    if bad := [m for m in metrics if have.get(m, 0) != 1]:
        raise ValueError(f"thresholds need exactly one row for {', '.join(bad)}")
    return table


def compress(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Identical class vectors as one weighted profile: what clustering by classes needs, whatever the rows."""
    return df.groupBy(*by, *features).agg(F.count(F.lit(1)).alias("weight"))


def balanced_profiles(df: DataFrame, features: Sequence[str], era: str = "era") -> DataFrame:
    """Profiles whose weights give every era the same total: weight, raw_count, eras_present."""
    per = compress(df, features, [era])
    sizes = per.groupBy(F.col(era).alias("lv_era")).agg(F.sum("weight").alias("era_rows"))
    mean = sizes.agg(F.avg("era_rows").alias("mean_rows"))
    joined = per.join(F.broadcast(sizes.crossJoin(mean)), F.col(era) == F.col("lv_era"))
    return joined.groupBy(*features).agg(F.sum(F.col("weight") * F.col("mean_rows") / F.col("era_rows")).alias("balanced_weight"), F.sum("weight").alias("raw_count"), F.count_distinct(era).alias("eras_present"))


def composition(df: DataFrame, group: str, part: str) -> DataFrame:
    """Rows of each part in its group, the group's total, and the share."""
    n = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(F.col(group).alias("lv_group")).agg(F.sum("n").alias("total"))
    return n.join(total, F.col(group).eqNullSafe(F.col("lv_group"))).select(group, part, "n", "total", (F.col("n") / F.col("total")).alias("share"))


def value_shares(df: DataFrame, group: str, metrics: Sequence[str], domain: Sequence[object]) -> DataFrame:
    """group, metric, value, n, share: every value of the domain is there, 0 if it never occurs."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("p")).select(group, "p.metric", "p.value")
    kind = long.schema["value"].dataType
    counted = long.groupBy(group, "metric").agg(F.count("value").alias("total"), *[F.count(F.when(F.col("value") == v, 1)).alias(f"lv_{i}") for i, v in enumerate(domain)])
    cells = F.explode(F.array(*[F.struct(F.lit(v).cast(kind).alias("value"), F.col(f"lv_{i}").alias("n")) for i, v in enumerate(domain)])).alias("c")
    return counted.select(group, "metric", "total", cells).select(group, "metric", "c.value", "c.n", (F.col("c.n") / F.nullif(F.col("total"), F.lit(0))).alias("share"))


def level_counts(df: DataFrame, key: str, metrics: Sequence[str], levels: Sequence[str] = ("Low", "Mid", "High")) -> DataFrame:
    """How often each metric had each level: len(metrics) * len(levels) counts a key, in one pass."""
    return df.groupBy(key).agg(*[F.count(F.when(F.col(m) == v, 1)).alias(f"{m}_{v.lower()}") for m in metrics for v in levels])


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population z-scores z_{col}; a constant column is divided by 1."""
    stats = df.agg(*[f(c).alias(f"lv_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"lv_m_{c}")) / F.when(F.col(f"lv_s_{c}") == 0, 1.0).otherwise(F.col(f"lv_s_{c}")) for c in cols})
    return out.drop(*[f"lv_{n}_{c}" for c in cols for n in "ms"])


def minmax(df: DataFrame, cols: Sequence[str], inverted: Sequence[str] = (), constant: float = 0.5) -> DataFrame:
    """scaled_{col} from 0 to 1 over all rows; inverted ones the other way round; a constant column gives `constant`."""
    ends = df.agg(*[f(c).alias(f"lv_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    for c in cols:
        lo, hi = F.col(f"lv_lo_{c}"), F.col(f"lv_hi_{c}")
        v = F.when(hi == lo, F.lit(constant)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0)))
        out = out.withColumn(f"scaled_{c}", F.when(hi == lo, v).otherwise(1 - v) if c in inverted else v)
    return out.drop(*[f"lv_{n}_{c}" for c in cols for n in ("lo", "hi")])


def nearest_prototype(df: DataFrame, cols: Sequence[str], prototypes: Sequence[Sequence[float]]) -> DataFrame:
    """`cluster` (from 1) of the prototype with the least Manhattan distance, the first on a tie, and that distance. Prototypes are constants of the plan."""
    far = [reduce(lambda a, b: a + b, [F.abs(F.col(c) - float(x)) for c, x in zip(cols, p)]) for p in prototypes]
    best = F.least(*far) if len(far) > 1 else far[0]
    return df.withColumns({"cluster": F.array_position(F.array(*far), best).cast("int"), "distance": best})
