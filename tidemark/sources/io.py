"""Readers and writers: tables in, tables out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _read_csv(spark: SparkSession, path: str, multi_line: bool, schema: str | None = None) -> DataFrame:
    """A field between quotes is text even if empty, one without is null if empty; a NUL before a quote stays, as the quote itself is what escapes it."""
    empty = uuid.uuid4().hex  # Spark's reader makes nulls of empty strings, so they bear a name until they are read
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "emptyValue": empty}
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[F.when(named(c) == empty, "").otherwise(named(c)).alias(c) if t == "string" else named(c) for c, t in df.dtypes])


def csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Declared types; quoted fields may hold doubled quotes, and line ends with multi_line, which makes each file one task."""
    df = _read_csv(spark, path, multi_line, schema)
    return df.select(*columns) if columns else df


def csv_if_present(spark: SparkSession, path: str, wanted: Sequence[str], multi_line: bool = False) -> DataFrame:
    """All columns as strings, those of `wanted` that the header has."""
    df = _read_csv(spark, path, multi_line)
    return df.select(*[c for c in wanted if c in df.columns])


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; what can't be read is in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def lines(spark: SparkSession, path: str, out: str = "id") -> DataFrame:
    """Distinct trimmed lines, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias(out)).filter(F.length(out) > 0).distinct()


def listing(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> list[tuple[str, int]]:
    """Path and length of all files below folder with one of the suffixes, on the driver as every listing is.

    Spark's own listing leaves out empty files and names that begin with _, which both occur among transcripts.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, out = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        if (path := f.getPath().toString()).rsplit(".", 1)[-1] in suffixes:
            out.append((path, int(f.getLen())))
    return sorted(out)


def _file_id(path: str) -> str:
    return path.rsplit("/", 1)[-1].lstrip("_").split(".", 1)[0]


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files by their paths, one at a time: for names that Spark doesn't read."""
    from pyarrow import fs

    for b in batches:
        for path in b.column(0).to_pylist():
            local = "/" + path.removeprefix("file:").lstrip("/")
            where, at = (fs.LocalFileSystem(), local) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
            with where.open_input_file(at) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], names=["io_path", "text"])


def texts(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("vtt", "srt", "txt", "empty")) -> DataFrame:
    """id, path, text of all files below folder: the id is the name without leading _ up to the first dot; of several files the last path counts."""
    chosen = {_file_id(path): (path, n) for path, n in listing(spark, folder, suffixes)}
    rows = spark.createDataFrame([(i, path, n) for i, (path, n) in chosen.items() if i], "id string, path string, io_n long")
    full = [path for i, (path, n) in chosen.items() if i and n]
    hidden = [p for p in full if p.rsplit("/", 1)[-1][0] in "_."]  # names that Spark's own listing leaves out: failed or partial ones, few
    empty = rows.filter("io_n = 0").select("id", "path", F.lit("").alias("text"))
    if not full:
        return empty
    some = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(folder)
    raw = some.select(F.col("path").alias("io_path"), F.decode("content", "UTF-8").alias("text"))
    if hidden:
        paths = spark.createDataFrame([(path,) for path in hidden], "io_path string")
        raw = raw.unionByName(paths.repartition(min(len(hidden), 1000)).mapInArrow(_read_texts, "io_path string, text string"))
    return rows.join(raw, F.col("path") == F.col("io_path")).select("id", "path", "text").union(empty)


def markers(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("vtt", "empty", "failed")) -> DataFrame:
    """id, kind of marker files; only names are read."""
    rows = {(_file_id(path), path.rsplit(".", 1)[-1]) for path, _ in listing(spark, folder, suffixes)}
    return spark.createDataFrame(sorted(rows), "id string, kind string")


def excel(spark: SparkSession, path: str, required: Sequence[str], sheet: int | str = 0) -> DataFrame:
    """A small sheet whose header is its first or second row: the one that has the required columns (labels compared by letters and digits)."""
    import pandas as pd

    label = lambda c: "".join(ch for ch in str(c).lower() if ch.isalnum())
    for header in (0, 1):
        table = pd.read_excel(path, sheet_name=sheet, header=header)
        if {label(c) for c in required} <= {label(c) for c in table.columns}:
            return spark.createDataFrame(table.astype(object).where(table.notna(), None).rename(columns={c: next((r for r in required if label(r) == label(c)), str(c)) for c in table.columns}))
    raise ValueError(f"no header with {', '.join(required)}")


POST_SCHEMA = "shortcode string, node struct<shortcode:string, edge_media_to_parent_comment:struct<edges:array<struct<node:struct<id:string,text:string,created_at:long,owner:struct<id:string>,edge_threaded_comments:struct<edges:array<struct<node:struct<id:string,text:string,created_at:long,owner:struct<id:string>>>>>>>>>>, webpage_url string, extractor string, comments array<struct<id:string,text:string,timestamp:long,author_id:string,parent:string>>, music_title string, music_artist string, audio_content struct<music_title:string,music_artist:string>"


def nested_posts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Posts as JSON documents in either of two dialects, one a line; with multi_line one a file, which makes each file one task."""
    return spark.read.schema(POST_SCHEMA).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def nested_comments(posts: DataFrame) -> DataFrame:
    """shortcode, comment_id, author_id, text, ts (epoch seconds), reply_to from both dialects, replies included."""
    code = F.coalesce("node.shortcode", "shortcode", F.nullif(F.regexp_extract(F.coalesce("webpage_url", F.lit("")), r"/(?:p|reel|tv)/([A-Za-z0-9_-]+)", 1), F.lit("")))
    top = posts.select(code.alias("shortcode"), F.explode("node.edge_media_to_parent_comment.edges").alias("e")).select("shortcode", F.col("e.node").alias("n"))
    one = lambda n, reply: [F.col(f"{n}.id").alias("comment_id"), F.col(f"{n}.owner.id").alias("author_id"), F.col(f"{n}.text").alias("text"), F.col(f"{n}.created_at").alias("ts"), reply.alias("reply_to")]
    parents = top.select("shortcode", *one("n", F.lit(None).cast("string")))
    replies = top.select("shortcode", F.col("n.id").alias("parent"), F.explode("n.edge_threaded_comments.edges").alias("r")).select("shortcode", F.col("parent"), F.col("r.node").alias("n"))
    replies = replies.select("shortcode", *one("n", F.col("parent")))
    flat = posts.select(code.alias("shortcode"), F.explode("comments").alias("c")).select("shortcode", F.col("c.id").alias("comment_id"), F.col("c.author_id").alias("author_id"), F.col("c.text").alias("text"), F.col("c.timestamp").alias("ts"), F.nullif(F.col("c.parent"), F.lit("root")).alias("reply_to"))
    return parents.unionByName(replies).unionByName(flat)


def music(posts: DataFrame) -> DataFrame:
    """shortcode, title, artist where either is known."""
    out = posts.select(F.coalesce("node.shortcode", "shortcode").alias("shortcode"), F.coalesce("music_title", "audio_content.music_title").alias("title"), F.coalesce("music_artist", "audio_content.music_artist").alias("artist"))
    return out.filter(F.col("title").isNotNull() | F.col("artist").isNotNull())


def by_shortcode(comments: DataFrame, corpus: DataFrame, permalink: str = "permalink", media: str = "media_id") -> DataFrame:
    """comments with media_id: the corpus' id of the post with this shortcode, else the shortcode itself."""
    table = corpus.select(F.nullif(F.regexp_extract(F.coalesce(permalink, F.lit("")), r"/(?:p|reel|tv)/([A-Za-z0-9_-]+)", 1), F.lit("")).alias("io_code"), F.col(media).alias("io_media")).filter("io_code IS NOT NULL").groupBy("io_code").agg(F.min("io_media").alias("io_media"))
    return comments.join(table, F.col("shortcode") == F.col("io_code"), "left").withColumn("media_id", F.coalesce("io_media", "shortcode")).drop("io_code", "io_media")


def json_columns(df: DataFrame, col: str, prefix: str = "", keys: Sequence[str] | None = None, max_keys: int = 2000) -> DataFrame:
    """A column for each key of a JSON object of numbers; text that is no object counts under other_clicks.

    keys: those that are known. Without, the distinct keys reach the driver, as they are the result's schema; more than max_keys raise.
    """
    parsed = F.from_json(col, "map<string,double>")
    as_map = df.withColumn("io_map", F.when(F.coalesce(F.col(col), F.lit("")).rlike(r"^\s*\{"), parsed).when(F.col(col).try_cast("double").isNotNull(), F.create_map(F.lit("other clicks"), F.col(col).try_cast("double"))))
    if keys is None:
        keys = sorted(r[0] for r in as_map.select(F.explode(F.map_keys("io_map"))).distinct().limit(max_keys + 1).collect())
        if len(keys) > max_keys:
            raise ValueError(f"more than {max_keys} keys; name those that are wanted")
    name = lambda k: prefix + "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in k).strip("_").lower()
    return as_map.select("*", *[F.try_element_at("io_map", F.lit(k)).alias(name(k)) for k in keys]).drop("io_map")


def write_csv(df: DataFrame, path: str, single: bool = False, bom: bool = False) -> None:
    """Values stay as they are, white space at their ends included; of one column alone, nulls are not kept, as they would be empty lines. single: one file, for a report that is known to be small. bom: every file begins with a byte order mark, as spreadsheets like it."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**options).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_in_batches(df: DataFrame, path: str, key: Column, batches: int) -> DataFrame:
    """Write df in batches by a hash of the key, each to a folder of its own, and read all back. A batch that is complete already is not done again, so a job that was cut off goes on where it stopped."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in range(batches):
        folder = f"{path}/batch={b}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
            df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*[f"{path}/batch={b}" for b in range(batches)])


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local session may go without."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or f"/tmp/{sc.applicationId}"


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nulls are written, arrays and maps as JSON."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_by_platform(df: DataFrame, path: str, platform: str = "platform") -> DataFrame:
    """A folder a platform; returns the manifest: platform, n_rows."""
    write_parquet(df, path, [platform])
    return df.groupBy(platform).agg(F.count(F.lit(1)).alias("n_rows"))


def summary_json(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """One row: a JSON object of aggregates."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()]).select(F.to_json(F.struct(*aggs), {"ignoreNullFields": "false"}).alias("summary"))


def publishable_ids(df: DataFrame, id_col: str) -> DataFrame:
    """What a queue would be sent: distinct known ids."""
    return df.select(id_col).dropna().distinct()
