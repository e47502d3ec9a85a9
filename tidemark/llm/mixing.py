"""Mix sources to target weights by thresholds on a hash of the document, without sorting.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``epochs`` times all words. A target stops at ``max_repeat`` times its source's size; the excess
is reshared by weight until none is above. That is the level L with sum(min(cap, L * weight)) =
budget, found in one pass over the sources in the order of cap / weight.

Take: each document is taken floor(target / source size) times. For the rest of the target, the
documents of the source whose hash lies below a threshold are taken once more. Histograms find
the threshold: words are summed by source and hash bucket, the bucket in which the rest of the
budget ends is refined by the hash's next bits, and so on to its last bit, so only rows of
boundary buckets are read again. A group of equal hashes is taken if the budget reaches its
middle, so a source misses its target by at most half a document and a rerun takes the same.
A smaller budget takes a subset of a larger one's documents.

Defined cases: null text has size 0. Rows that repeat a doc_id (or have none) share a hash and
are taken alike. An empty table gives an empty result; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, read, text_or_empty

WEIGHTS = (5, 2, 1)
EPOCHS, MAX_REPEAT, SEED = 1.5, 2, "mix"
#: The hash has LEVELS * BITS bits; each level's histogram has at most 2**BITS rows a source.
LEVELS, BITS = 5, 12
#: One row a source; beyond so many, the join by source shuffles (adaptive execution splits hot sources).
MAX_BROADCAST_SOURCES = 200_000


def words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def hash60(id_col: Column, seed: str = SEED) -> Column:
    """60 bits of md5(seed : id), which any SQL engine can repeat."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """mx_source, source_size, target from one row a source. The windows run over sources, not documents."""
    by_name, by_turn = W.orderBy(F.col("mx_source").asc_nulls_last()), W.orderBy("turn", F.col("mx_source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    t = sizes.select("mx_source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_repeat)).alias("cap"))
    t = t.withColumn("turn", F.col("cap") / F.col("weight"))
    rows = by_turn.rowsBetween(W.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.coalesce(F.sum("cap").over(rows), F.lit(0.0)).alias("full"),
        F.sum("weight").over(by_turn.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * float(epochs)).alias("budget"),
    )
    # Sources before this one stop at their caps; the level at which the others would share what is left.
    level = F.max(F.when((F.col("budget") - F.col("full")) / F.col("open") <= F.col("turn"), (F.col("budget") - F.col("full")) / F.col("open"))).over(
        W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return t.select("mx_source", "source_size", F.when(F.col("turn") <= level, F.col("cap")).otherwise(F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with mx_times (whole copies of each document) and mx_limit (hashes below it are taken once more)."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = goals.select("*", times.alias("mx_times")).select("*", (F.col("target") - F.col("mx_times") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for depth in range(LEVELS):
        shift = BITS * (LEVELS - 1 - depth)
        bucket = F.shiftright("mx_hash", shift)
        goal = at.select(F.col("mx_source").alias("g_source"), F.col("rest"), F.col("prefix"))
        inside = sized if depth == 0 else sized.join(goal, F.col("mx_source").eqNullSafe(F.col("g_source")) & (F.shiftright("mx_hash", shift + BITS) == F.col("prefix"))).select("mx_source", "mx_hash", "mx_size")
        hist = inside.groupBy("mx_source", bucket.alias("bucket")).agg(F.sum("mx_size").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("mx_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = hist.select("mx_source", "bucket", "n", before.alias("before")).join(goal.drop("prefix"), F.col("mx_source").eqNullSafe(F.col("g_source")))
        reach = F.col("before") + (F.col("n") if depth < LEVELS - 1 else F.col("n") / 2)
        edge = found.filter(reach > F.col("rest")).groupBy("g_source").agg(F.min(F.struct("bucket", "before")).alias("edge"))
        at = at.join(edge, F.col("mx_source").eqNullSafe(F.col("g_source")), "left").select(
            "mx_source", "source_size", "target", "mx_times",
            (F.col("rest") - F.coalesce(F.col("edge.before"), F.lit(0))).alias("rest"),
            # No such bucket: everything at this level is taken, and the prefix leaves the hash's range.
            F.coalesce(F.col("edge.bucket"), F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
        )
        at = checkpointed(at)
    return at.select("mx_source", "source_size", "target", "mx_times", F.col("prefix").alias("mx_limit"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT, keep_text: bool = False) -> DataFrame:
    """Each document's size, source_size, target and copies (0 to max_repeat).

    Without keep_text: doc_id, source and these. With it: all input columns (those of these names replaced) and copies.
    """
    own = lambda c: F.col(f"`{c}`")
    sized = checkpointed(docs.select(own(id_col).alias("mx_id"), own(source_col).cast("string").alias("mx_source"), hash60(own(id_col)).alias("mx_hash"), words(own(text_col)).alias("mx_size")))
    goals = checkpointed(targets(sized.groupBy("mx_source").agg(F.sum("mx_size").alias("source_size")), weights, epochs, max_repeat))
    plan = thresholds(sized, goals).withColumnRenamed("mx_source", "g_source")
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    if keep_text:
        rows = docs.select(F.struct(*[own(c) for c in docs.columns]).alias("mx_in"), own(source_col).cast("string").alias("mx_source"), hash60(own(id_col)).alias("mx_hash"))
    else:
        rows = sized
    # Only an empty document can be below the limit of a source whose target is its cap.
    copies = F.least(F.col("mx_times") + F.when(F.col("mx_hash") < F.col("mx_limit"), 1).otherwise(0), F.lit(max_repeat)).cast("long")
    joined = rows.join(plan, F.col("mx_source").eqNullSafe(F.col("g_source")))
    if keep_text:
        return joined.select(*[F.col(f"mx_in.`{c}`").alias(c) for c in docs.columns if c.lower() != "copies"], copies.alias("copies"))
    return joined.select(F.col("mx_id").alias(id_col), F.col("mx_source").alias(source_col), F.col("mx_size").alias("size"), "source_size", "target", copies.alias("copies"))


#: Rows of {docs} with their size, source_size, target and copies.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT 0 AS step, source, source_size, weight, cap, false AS stopped, 1.5::DOUBLE * (sum(source_size) OVER ()) AS budget FROM w
  UNION ALL
  SELECT step + 1, source, source_size, weight, cap,
         stopped OR cap <= weight * ((budget - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0)), budget
  FROM r WHERE step < 60
), t AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap ELSE weight * ((budget - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0)) END AS target
  FROM r WHERE step = 60
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t
), g AS (
  SELECT source, h, sum(size) AS n FROM d GROUP BY source, h
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) - n / 2 AS middle FROM g
)
SELECT d.* EXCLUDE (h), u.source_size, u.target, (u.times + (c.middle <= u.target - u.times * u.source_size)::INT)::BIGINT AS copies
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = f"SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM ({ORACLE.format(docs='documents')})"
