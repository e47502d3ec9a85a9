"""Tables written in each format, and read back by the same module's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import levels
from ..sources import io
from .bindings import Query, table
from .content import docs


def _folder(spark, name: str) -> str:
    """A folder of its own in the shared one, gone with the session."""
    folder = f"{io.scratch(spark)}/formats-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def csv_round_trip(spark, d):
    """Texts with quotes and line ends included."""
    at = _folder(spark, "csv")
    quoted = F.concat(F.lit('a "quoted", '), F.col("text"))
    io.write_csv(docs(spark, d).select("doc_id", "source", quoted.alias("text"), "n_chars"), at)
    return io.csv(spark, at, "doc_id long, source string, text string, n_chars long", ["doc_id", "source", "text"], multi_line=True).select("doc_id", "source", F.md5("text").alias("text_md5"))


def csv_wanted_columns(spark, d):
    at = _folder(spark, "wanted")
    io.write_csv(docs(spark, d).select("doc_id", "source", "lang"), at, bom=True)
    out = io.csv_if_present(spark, at, ["lang", "nothing", "source"])
    return out.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def jsonl_round_trip(spark, d):
    at = _folder(spark, "jsonl")
    io.write_jsonl(docs(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang")), at)
    out = io.jsonl(spark, at, "doc_id long, text string, lang string")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "lang", F.col("_corrupt_record").isNull().alias("whole"))


def text_lines(spark, d):
    at = _folder(spark, "lines")
    docs(spark, d).select(F.explode(F.array(F.concat(F.lit("  "), "source", F.lit(" ")), F.lit(""), F.col("lang"))).alias("value")).write.text(at)
    return io.lines(spark, at, "line")


def _small_files(spark, d, at: str) -> None:
    """A file a nation: every third is empty, every fourth has a name that begins with _."""
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # the whole table: 25 rows
        k = r["n_nationkey"]
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k % 2}/{'_' if k % 4 == 0 else ''}n{k}.en.{'empty' if k % 3 == 0 else 'vtt'}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        if k % 3:
            out.write(bytearray(r["n_name"].encode()))
        out.close()


def transcript_files(spark, d):
    _small_files(spark, d, at := _folder(spark, "texts"))
    return io.texts(spark, at).select("id", "text")


def marker_files(spark, d):
    _small_files(spark, d, at := _folder(spark, "markers"))
    return io.markers(spark, at)


def nested_comments(spark, d):
    """Conversations as posts in two dialects: even ones nest replies below comments, odd ones list comments flat."""
    t = table(spark, d, "conversations")
    one = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.col("turn").cast("long").alias("created_at"), F.struct(F.col("role").alias("id")).alias("owner"))
    flat = F.struct(F.col("turn"), one["id"].alias("id"), F.col("text").alias("text"), F.col("turn").cast("long").alias("timestamp"), F.col("role").alias("author_id"), F.when(F.col("turn") == 0, "root").otherwise(F.concat(F.col("conv_id").cast("string"), F.lit("-0"))).alias("parent"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("c")))).alias("cs"), F.array_sort(F.collect_list(flat)).alias("fs"))
    code = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    first, rest = F.get("cs", F.lit(0))["c"], F.slice("cs", F.lit(2), F.size("cs"))
    threads = F.struct(F.transform(rest, lambda x: F.struct(x["c"].alias("node"))).alias("edges"))
    node = F.struct(first["id"].alias("id"), first["text"].alias("text"), first["created_at"].alias("created_at"), first["owner"].alias("owner"), threads.alias("edge_threaded_comments"))
    nested = F.to_json(F.struct(F.struct(code.alias("shortcode"), F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("edge_media_to_parent_comment")).alias("node")))
    listed = F.to_json(F.struct(F.concat(F.lit("https://x.y/reel/"), code, F.lit("/")).alias("webpage_url"), F.col("fs").alias("comments")))
    at = _folder(spark, "nested")
    g.select(F.when(F.col("conv_id") % 2 == 0, nested).otherwise(listed).alias("value")).write.text(at)
    return io.nested_comments(io.nested_posts(spark, at)).select("shortcode", "comment_id", "author_id", F.md5("text").alias("text_md5"), "ts", "reply_to")


def post_music(spark, d):
    p = table(spark, d, "pages").select("page_id")
    title = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    rows = p.select(F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(title.alias("shortcode"), title.alias("music_title")))).when(F.col("page_id") % 3 == 1, F.to_json(F.struct(title.alias("shortcode"), F.struct(title.alias("music_artist")).alias("audio_content")))).otherwise(F.to_json(F.struct(title.alias("shortcode")))).alias("value"))
    at = _folder(spark, "music")
    rows.write.text(at)
    return io.music(io.nested_posts(spark, at))


def by_shortcode(spark, d):
    """Comments whose post is known take its id, others keep the shortcode."""
    p = table(spark, d, "pages")
    code = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    corpus = p.filter("page_id % 2 = 0").select(F.concat(F.lit("https://x.y/p/"), code, F.lit("/")).alias("permalink"), F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("media_id"))
    return io.by_shortcode(p.select("page_id", code.alias("shortcode")), corpus).select("page_id", "media_id")


def by_platform(spark, d):
    at = _folder(spark, "platform")
    io.write_by_platform(docs(spark, d).select("doc_id", "lang", F.col("source").alias("platform")), at)
    return io.parquet(spark, at, ["platform", "doc_id"]).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def saved_in_batches(spark, d):
    at = _folder(spark, "batches")
    return io.write_in_batches(docs(spark, d).select("doc_id", "lang"), at, F.col("doc_id"), 3).select("doc_id", "lang")


def summary_json(spark, d):
    return io.summary_json(docs(spark, d), {"rows": F.count(F.lit(1)), "longest": F.max("n_chars"), "none": F.max(F.lit(None).cast("long"))})


def publishable_ids(spark, d):
    return io.publishable_ids(table(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("id")), "id")


def threshold_table(spark, d):
    """Thresholds from a file, each metric there exactly once."""
    at = _folder(spark, "thresholds")
    rows = spark.createDataFrame([("recency", 1.5, 3.0), ("frequency", 0.25, 2.0), ("other", 0.0, 0.0), ("other", 1.0, 1.0)], "metric string, threshold_1 double, threshold_2 double")
    io.write_csv(rows, at, single=True)
    return levels.check_thresholds(io.csv(spark, at, "metric string, threshold_1 double, threshold_2 double"), ["recency", "frequency"]).filter(F.col("metric") != "other")


_NATIONS = "SELECT n_nationkey AS k, n_name FROM nation"
QUERIES: dict[str, Query] = {
    "csv_round_trip": (csv_round_trip, """SELECT doc_id, source, md5('a "quoted", ' || text) AS text_md5 FROM documents"""),
    "csv_wanted_columns": (csv_wanted_columns, "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2"),
    "jsonl_round_trip": (jsonl_round_trip, "SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, true AS whole FROM documents"),
    "text_lines": (text_lines, "SELECT source AS line FROM documents UNION SELECT lang FROM documents"),
    "transcript_files": (transcript_files, f"SELECT 'n' || k AS id, CASE WHEN k % 3 = 0 THEN '' ELSE n_name END AS text FROM ({_NATIONS})"),
    "marker_files": (marker_files, f"SELECT 'n' || k AS id, CASE WHEN k % 3 = 0 THEN 'empty' ELSE 'vtt' END AS kind FROM ({_NATIONS})"),
    "nested_comments": (nested_comments, "SELECT 'c' || conv_id AS shortcode, conv_id || '-' || turn AS comment_id, role AS author_id, md5(text) AS text_md5, turn::BIGINT AS ts, CASE WHEN turn > 0 THEN conv_id || '-0' END AS reply_to FROM conversations"),
    "post_music": (post_music, "SELECT 't' || page_id AS shortcode, CASE WHEN page_id % 3 = 0 THEN 't' || page_id END AS title, CASE WHEN page_id % 3 = 1 THEN 't' || page_id END AS artist FROM pages WHERE page_id % 3 < 2"),
    "by_shortcode": (by_shortcode, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'm' ELSE 's' END || page_id AS media_id FROM pages"),
    "by_platform": (by_platform, "SELECT source AS platform, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1"),
    "saved_in_batches": (saved_in_batches, "SELECT doc_id, lang FROM documents"),
    "summary_json": (summary_json, """SELECT '{"rows":' || count(*) || ',"longest":' || max(n_chars) || ',"none":null}' AS summary FROM documents"""),
    "publishable_ids": (publishable_ids, "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 5 <> 0"),
    "threshold_table": (threshold_table, "SELECT * FROM (VALUES ('recency', 1.5::DOUBLE, 3.0::DOUBLE), ('frequency', 0.25, 2.0)) v(metric, threshold_1, threshold_2)"),
}
