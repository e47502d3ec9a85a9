"""Transcript tables: jobs, rejects, pooling, status, containment of short in long."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def content_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with source_hash and reject_reason: empty, duplicate (an earlier id has the same content), or null for what is kept."""
    rows = df.withColumn("source_hash", F.when(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0, T.normal_hash(F.col(text_col))))
    # Only hashes that occur more than once are joined: few, as a rule, so the texts stay where they are. Null hashes take no part, and rows that repeat an id are one.
    hashes = rows.select("source_hash", F.col(id_col).alias("tr_id")).filter(F.col("source_hash").isNotNull())
    first = hashes.groupBy(F.col("source_hash").alias("tr_hash")).agg(F.min("tr_id").alias("tr_first"), F.max("tr_id").alias("tr_last")).filter("tr_first <> tr_last").drop("tr_last")
    # A key of its own for every row without hash, so that they don't meet in one task.
    key = F.coalesce(F.col("source_hash"), F.concat(F.lit("none "), F.col(id_col).cast("string")))
    joined = rows.withColumn("tr_key", key).join(first, F.col("tr_key") == F.col("tr_hash"), "left").drop("tr_key")
    why = F.when(F.col("source_hash").isNull(), "empty_transcript").when(F.col(id_col) != F.col("tr_first"), "duplicate_content")
    return joined.withColumn("reject_reason", why).drop("tr_hash", "tr_first")


def jobs(df: DataFrame, id_col: str = "video_id", text_col: str = "text", size: int = 1440, overlap: int = 120, prompt_version: str = "v1") -> DataFrame:
    """One row a chunk: job_id, video_id, chunk_idx, chunk_total, chunk_text, estimated_input_tokens, source_hash, prompt_version."""
    kept = content_dedup(df, id_col, text_col).filter("reject_reason IS NULL")
    parts = kept.withColumn("tr_chunks", T.chunks(F.col(text_col), size, overlap))
    out = parts.select(F.col(id_col).alias("video_id"), "source_hash", F.size("tr_chunks").alias("chunk_total"), F.posexplode("tr_chunks").alias("chunk_idx", "chunk_text"))
    return out.select(F.format_string("%s_%03d", F.col("video_id").cast("string"), "chunk_idx").alias("job_id"), "video_id", "chunk_idx", "chunk_total", "chunk_text", T.token_estimate(F.col("chunk_text")).alias("estimated_input_tokens"), "source_hash", F.lit(prompt_version).alias("prompt_version"))


def manifest(job_rows: DataFrame) -> DataFrame:
    return job_rows.agg(F.count(F.lit(1)).alias("jobs"), F.count_distinct("video_id").alias("videos"), F.sum("estimated_input_tokens").alias("total_tokens"), F.avg("estimated_input_tokens").alias("mean_tokens"))


def pool(files: DataFrame, id_col: str, path_col: str, sep: str = " | ") -> DataFrame:
    """Paths of each id, sorted and joined; an id's own paths are gathered, no more."""
    return files.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_list(path_col)), sep).alias("paths"))


def status(master: DataFrame, id_col: str, sets: Mapping[str, DataFrame], default: str = "unassigned") -> DataFrame:
    """`status` of each id: the first of the sets (in their order) that holds it."""
    out, label = master, F.lit(None).cast("string")
    for name, ids in reversed(sets.items()):
        out = out.join(ids.select(F.col(id_col).alias(f"tr_{name}")).distinct(), F.col(id_col) == F.col(f"tr_{name}"), "left")
        label = F.when(F.col(f"tr_{name}").isNotNull(), name).otherwise(label)
    return out.withColumn("status", F.coalesce(label, F.lit(default))).drop(*[f"tr_{n}" for n in sets])


def retry_queue(df: DataFrame, priorities: Sequence[str], id_col: str) -> DataFrame:
    """Rows in the order of their status' priority; a status that has none comes last with a null."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(priorities))):
        rank = F.when(F.col("status") == name, i + 1).otherwise(rank)
    return df.withColumn("priority", rank).orderBy(F.asc_nulls_last("priority"), id_col)


def matched_share(short: list[str], long: list[str]) -> float:
    """Words of short inside matching blocks of long, by its length (the library's default heuristics included)."""
    return sum(b.size for b in difflib.SequenceMatcher(None, short, long).get_matching_blocks()) / len(short) if short else 0.0


def containment(shorts: DataFrame, longs: DataFrame, by: str, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """short_id, long_id, ratio: for each short the long of the same `by` that holds most of it, if at least threshold.

    Candidates come from shared words: the rarest (1 - threshold) part of a short's distinct words and one more must
    meet the long's words, as a long that misses all of those can't reach the share. So only likely pairs form, and
    they are checked by the share of distinct words before the blocks are matched in Python.
    """
    side = lambda df, p: df.select(F.col(by).alias(f"{p}_by"), F.col(id_col).alias(f"{p}_id"), T.match_words(F.col(text_col)).alias(f"{p}_words")).withColumn(f"{p}_set", F.array_distinct(f"{p}_words")).filter(F.size(f"{p}_set") > 0)
    s, l = side(shorts, "s"), side(longs, "l")  # noqa: E741
    own = s.select(F.col("s_by").alias("o_by"), F.col("s_id").alias("o_id"), F.size("s_set").alias("n"), F.explode("s_set").alias("o_w"))
    grams = l.select(F.col("l_by").alias("g_by"), F.col("l_id").alias("g_id"), F.explode("l_set").alias("g_w"))
    known = grams.groupBy(F.col("g_by").alias("k_by"), F.col("g_w").alias("k_w")).agg(F.count(F.lit(1)).alias("df"))
    mine = own.join(known, (F.col("o_by") == F.col("k_by")) & (F.col("o_w") == F.col("k_w")), "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("o_by", "o_id").orderBy("df", "o_w"))
    probes = mine.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("o_by", "o_id", "o_w")
    pairs = probes.join(grams, (F.col("o_by") == F.col("g_by")) & (F.col("o_w") == F.col("g_w"))).select("o_by", "o_id", "g_id").distinct()
    # Candidates meet with the hashes of their distinct words only; the words are fetched for the pairs that are left.
    hashes = lambda df, p: df.select(f"{p}_by", f"{p}_id", F.transform(f"{p}_set", lambda w: F.xxhash64(w)).alias(f"{p}_h"))
    both = pairs.join(hashes(s, "s"), (F.col("o_by") == F.col("s_by")) & (F.col("o_id") == F.col("s_id"))).join(hashes(l, "l"), (F.col("o_by") == F.col("l_by")) & (F.col("g_id") == F.col("l_id")))
    near = both.filter(F.size(F.array_intersect("s_h", "l_h")) / F.size("s_h") >= threshold).select("o_by", "o_id", "g_id")
    likely = near.join(s, (F.col("o_by") == F.col("s_by")) & (F.col("o_id") == F.col("s_id"))).join(l, (F.col("o_by") == F.col("l_by")) & (F.col("g_id") == F.col("l_id"))).select("s_by", "s_id", "l_id", "s_words", "l_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratio = pa.array([matched_share(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), ratio], names=["by", "short_id", "long_id", "ratio"])

    kinds = {f.name: f.dataType.simpleString() for f in likely.schema.fields}
    scored = likely.mapInArrow(run, f"by {kinds['s_by']}, short_id {kinds['s_id']}, long_id {kinds['l_id']}, ratio double").filter(F.col("ratio") >= threshold)
    best = F.min_by(F.struct("long_id", "ratio"), F.struct((-F.col("ratio")).alias("r"), F.col("long_id")))
    return scored.groupBy("by", "short_id").agg(best.alias("m")).select(F.col("by").alias(by), "short_id", "m.long_id", "m.ratio")


def duplicates_of(shorts: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    """shorts with is_duplicate: whether containment() found a long video that holds it."""
    known = matches.select(F.col("short_id").alias("tr_short")).distinct()
    return shorts.join(known, F.col(id_col) == F.col("tr_short"), "left").withColumn("is_duplicate", F.col("tr_short").isNotNull()).drop("tr_short")


def choose_overlay(df: DataFrame, own: str, href: str, description: str) -> DataFrame:
    c = T.connection(F.col(own), T.link_target(F.col(href)), T.links(F.col(description), F.col(own)))
    return df.withColumn("tr_c", c).select("*", "tr_c.*").drop("tr_c")
