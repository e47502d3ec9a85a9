"""Reports on tables: missing values, shifts, correlations, distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, n_missing, pct_missing of each column, in one pass."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("qa_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"qa_{i}") for i, c in enumerate(cols)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"qa_{i}").alias("n_missing")) for i, c in enumerate(cols)])).alias("c")
    return one.select("qa_n", cells).select("c.column", "c.n_missing", F.when(F.col("qa_n") > 0, F.col("c.n_missing") * 100.0 / F.col("qa_n")).otherwise(0.0).alias("pct_missing"))


def moments_shift(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """Means, sample deviations and their changes in percent."""
    side = lambda df, p: df.agg(F.avg(col).alias(f"mean_{p}"), F.stddev_samp(col).alias(f"std_{p}"))
    both = side(before, "before").crossJoin(side(after, "after"))  # one row each
    change = lambda n: (F.col(f"{n}_after") - F.col(f"{n}_before")) / F.nullif(F.abs(F.col(f"{n}_before")), F.lit(0.0)) * 100
    return both.withColumns({"mean_change_pct": change("mean"), "std_change_pct": change("std")})


#: Values are put into so many ranges, so that no task sees them all.
CELLS = 200


def running(n: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """n (a row for each of by and v) with <c>_before and <c>_total of each column c: the sums over smaller v, and over all, of the group.

    Ranges end at approximate quantiles of the values, so skewed values spread over them; they only deal out the work, and no result depends on them.
    """
    ends = n.agg(F.percentile_approx("v", [i / CELLS for i in range(1, CELLS)], 10_000).alias("qa_ends"))
    spread = n.crossJoin(F.broadcast(ends)).withColumn("qa_cell", F.size(F.filter("qa_ends", lambda e: e < F.col("v")))).drop("qa_ends")
    group, keys = W.partitionBy(*by) if by else W.partitionBy(F.lit(0)), [*by, "qa_cell"]
    cells = spread.groupBy(*keys).agg(*[F.sum(c).alias(f"qa_{c}") for c in cols])  # CELLS rows a group at most
    ahead = cells.select(
        *[F.col(k).alias(f"qa_k_{k}") for k in keys], *[F.coalesce(F.sum(f"qa_{c}").over(group.orderBy("qa_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"qa_a_{c}") for c in cols],
        *[F.sum(f"qa_{c}").over(group).alias(f"{c}_total") for c in cols],
    )
    inside = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    rows = spread.withColumns({f"qa_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"qa_k_{k}"))
    return rows.join(ahead if by else F.broadcast(ahead), same).select(*n.columns, *[(F.col(f"qa_a_{c}") + F.col(f"qa_i_{c}")).alias(f"{c}_before") for c in cols], *[f"{c}_total" for c in cols])


def counted(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """by, v (known values as doubles), n, n_before, n_total."""
    v = F.col(col).cast("double")
    return running(df.filter(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("n")), by, ["n"])


def quantiles(df: DataFrame, col: str, at: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by, one column a quantile, linear between the two values around it: like percentile(), but from counts, so no buffer holds all values."""
    rows = counted(df, col, by)
    aggs = []
    for name, q in at.items():
        pos = (F.col("n_total") - 1) * F.lit(float(q))
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        low, high = F.max(F.when(holds(F.floor(pos)), F.col("v"))), F.max(F.when(holds(F.ceil(pos)), F.col("v")))
        part = F.max(pos - F.floor(pos))
        aggs.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def ks_statistic(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """statistic, n_before, n_after: the largest gap between the two distribution functions.

    Values are reduced to counts first; the running sums go over ranges of values and then within each, so no task sees them all.
    """
    tagged = before.select(F.col(col).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(after.select(F.col(col).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).filter("v IS NOT NULL")
    n = tagged.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = running(n, [], ["a", "b"])
    gap = F.abs((F.col("a") + F.col("a_before")) / F.col("a_total") - (F.col("b") + F.col("b_before")) / F.col("b_total"))
    return rows.agg(F.max(gap).alias("statistic"), F.max("a_total").alias("n_before"), F.max("b_total").alias("n_after"))


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value (Kolmogorov's series with the usual small-sample correction)."""
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * statistic
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def shift_flags(moments: DataFrame, statistic: DataFrame, limit_pct: float = 10.0, alpha: float = 0.05) -> dict:
    """What a caller looks at: a row each reaches the driver."""
    m, s = moments.first().asDict(), statistic.first()
    p = ks_p_value(s["statistic"], s["n_before"], s["n_after"])
    return m | {"statistic": s["statistic"], "p_value": p, "shifted": abs(m["mean_change_pct"] or 0) > limit_pct or abs(m["std_change_pct"] or 0) > limit_pct or p < alpha}


def correlations(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """column, r: Pearson over the rows where both are known, by absolute value."""
    one = df.agg(*[F.corr(F.when(F.col(c).isNotNull(), F.col(target)), F.when(F.col(target).isNotNull(), F.col(c))).alias(f"qa_{i}") for i, c in enumerate(cols)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"qa_{i}").alias("r")) for i, c in enumerate(cols)])).alias("c")
    return one.select(cells).select("c.*").orderBy(F.desc_nulls_last(F.abs("r")), "column")


def threshold_shares(df: DataFrame, metrics: dict[str, Sequence[float]], by: str | None = None) -> DataFrame:
    """metric, threshold, share of known values up to it; per `by` and overall ('all')."""
    picks = [(m, t) for m, ts in metrics.items() for t in ts]
    aggs = [F.avg(F.when(F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")), (F.col(m) <= t).cast("double"))).alias(f"qa_{i}") for i, (m, t) in enumerate(picks)]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(t)).alias("threshold"), F.col(f"qa_{i}").alias("share")) for i, (m, t) in enumerate(picks)])).alias("c")
    total = df.agg(*aggs).select(F.lit("all").alias("grp"), cells)
    if by is not None:
        total = total.unionByName(df.groupBy(F.col(by).cast("string").alias("grp")).agg(*aggs).select("grp", cells))
    return total.select("grp", "c.*")


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float) -> DataFrame:
    """bin (from 0), n, density over [lo, hi]; every bin is there, the last one closed."""
    width = (hi - lo) / bins
    v = F.col(col).cast("double")
    n = df.filter((v >= lo) & (v <= hi)).groupBy(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(F.broadcast(n), "bin", "left").fillna(0, ["n"])
    return full.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def smooth(hist: DataFrame, sigma: float = 3.0, radius: int = 12, col: str = "density") -> DataFrame:
    """hist with `smoothed`: a Gaussian kernel over neighbouring bins, zero beyond the ends. Its window runs over bins, not rows."""
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    order = W.orderBy("bin")
    parts = [F.coalesce(F.lag(col, -i).over(order) if i < 0 else F.lead(col, i).over(order) if i else F.col(col), F.lit(0.0)) * (k / sum(kernel)) if i > 0 else F.coalesce(F.lag(col, -i).over(order) if i else F.col(col), F.lit(0.0)) * (k / sum(kernel)) for i, k in zip(range(-radius, radius + 1), kernel)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return hist.withColumn("smoothed", total)


def kde(df: DataFrame, col: str, grid: Sequence[float], multiplier: float = 1.0) -> DataFrame:
    """x, density: Gaussian kernels at Silverman's bandwidth, for each point of a short grid, in one pass of partial sums."""
    v = F.col(col).cast("double")
    middle = quantiles(df, col, {"qa_p25": 0.25, "qa_p75": 0.75}).select((F.col("qa_p75") - F.col("qa_p25")).alias("iqr"))
    stats = df.agg(F.stddev_samp(v).alias("sd"), F.count(v).alias("n")).crossJoin(middle)  # one row each
    spread = F.least(F.col("sd"), F.when(F.col("iqr") > 0, F.col("iqr") / 1.34).otherwise(F.col("sd")))
    band = stats.select((spread * 0.9 * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * multiplier).alias("h"), "n")
    rows = df.filter(v.isNotNull()).select(v.alias("v")).crossJoin(F.broadcast(band))
    sums = rows.agg(F.max("h").alias("h"), F.max("n").alias("n"), *[F.sum(F.exp(-0.5 * F.pow((F.lit(float(x)) - F.col("v")) / F.col("h"), F.lit(2.0)))).alias(f"qa_{i}") for i, x in enumerate(grid)])
    cells = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"qa_{i}").alias("s")) for i, x in enumerate(grid)])).alias("c")
    return sums.select("h", "n", cells).select("c.x", (F.col("c.s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """value, n, cumulative, share: a row a distinct value; running sums go over counts."""
    kind = df.schema[col].dataType
    up_to = F.col("n_before") + F.col("n")
    return counted(df, col).select(F.col("v").cast(kind).alias("value"), "n", up_to.alias("cumulative"), (up_to / F.col("n_total")).alias("share"))


def percentile_rank(df: DataFrame, col: str, value: float) -> Column | DataFrame:
    return df.agg(F.avg((F.col(col) <= value).cast("double")).alias("rank"))


def reconcile(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """df with sum_of_parts (nulls count as zero) and difference, total minus that."""
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    return df.withColumn("sum_of_parts", whole).withColumn("difference", F.col(total) - F.col("sum_of_parts"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, p25, p50, p75, max of the known values; quantiles interpolate, from counts of values."""
    v = F.col(col).cast("double")
    one = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return one.crossJoin(quantiles(df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by the value: a report of fixed length."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """row, one count a value; values that don't occur have zero."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(col) == v, 1)).alias(str(v)) for v in values])


def label_changes(df: DataFrame, before: str, after: str, called: Column) -> DataFrame:
    """before, after, n, called: how many rows went from one label to the other, and the share of them that were looked at again."""
    return df.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"), F.avg(called.cast("double")).alias("called"))


def file_bytes(spark, path: str) -> int:
    """Bytes of all files below a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def inventory(tables: dict[str, DataFrame], paths: dict[str, str] | None = None) -> DataFrame:
    """table, n_rows, n_columns; with paths also n_bytes of their files."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        if paths is not None:
            one = one.withColumn("n_bytes", F.lit(file_bytes(df.sparkSession, paths[name])).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out
