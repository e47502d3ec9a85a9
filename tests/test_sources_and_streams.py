"""Files in and out, and the windows on a stream."""

import json

from pyspark.sql import functions as F

from tidemark.sources import io
from tidemark.streaming import windows


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi",\nyou'), ("2", None)], "id string, text string")
    io.write_csv(df, f"{tmp_path}/c", single=True)
    assert sorted(map(tuple, io.csv(spark, f"{tmp_path}/c", "id string, text string", multi_line=True).collect())) == [("1", 'say "hi",\nyou'), ("2", None)]
    assert io.csv_if_present(spark, f"{tmp_path}/c", ["text", "nope"]).columns == ["text"]


def test_jsonl_keeps_nulls_and_bad_lines(spark, tmp_path):
    io.write_jsonl(spark.createDataFrame([("a", None)], "id string, x long"), f"{tmp_path}/j")
    assert io.jsonl(spark, f"{tmp_path}/j", "id string, x long").select("id", "x").collect() == [("a", None)]
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "x": 1}\nnot json\n')
    rows = io.jsonl(spark, f"{tmp_path}/bad.jsonl", "id string, x long").collect()
    assert sorted((r.id is None, r._corrupt_record is None) for r in rows) == [(False, True), (True, False)]


def test_files_by_name(spark, tmp_path):
    for name, text in {"a/_id1.it.vtt": "one", "b/id1.txt": "two", "b/id2.empty": "", "b/id3.jpg": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, io.markers(spark, str(tmp_path), ["vtt", "empty"]).collect())) == [("id1", "vtt"), ("id2", "empty")]
    got = {r.id: r.text for r in io.texts(spark, str(tmp_path)).collect()}
    assert got == {"id1": "two", "id2": ""}
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.id for r in io.lines(spark, f"{tmp_path}/ids.txt").collect()) == ["a", "b"]


def test_nested_posts(spark, tmp_path):
    reply = {"node": {"id": "c2", "text": "re", "created_at": 2, "owner": {"id": "v"}}}
    top = {"node": {"id": "c1", "text": "hi", "created_at": 1, "owner": {"id": "u"}, "edge_threaded_comments": {"edges": [reply]}}}
    (tmp_path / "1.json").write_text(json.dumps({"node": {"shortcode": "AAA", "edge_media_to_parent_comment": {"edges": [top]}}, "music_title": "song"}))
    (tmp_path / "2.json").write_text(json.dumps({"webpage_url": "https://x.y/reel/BBB/", "extractor": "z", "comments": [{"id": "c3", "text": "yo", "timestamp": 3, "author_id": "w", "parent": "root"}], "audio_content": {"music_artist": "who"}}))
    posts = io.nested_posts(spark, str(tmp_path))
    got = {r.comment_id: (r.shortcode, r.author_id, r.text, r.ts, r.reply_to) for r in io.nested_comments(posts).collect()}
    assert got == {"c1": ("AAA", "u", "hi", 1, None), "c2": ("AAA", "v", "re", 2, "c1"), "c3": ("BBB", "w", "yo", 3, None)}
    assert io.music(posts).count() == 2
    corpus = spark.createDataFrame([("m9", "https://x.y/p/AAA/")], "media_id string, permalink string")
    assert {r.media_id for r in io.by_shortcode(io.nested_comments(posts), corpus).collect()} == {"m9", "BBB"}


def test_json_columns(spark):
    df = spark.createDataFrame([(1, '{"a b": 1, "c": 2.5}'), (2, "7"), (3, None), (4, "{broken")], "id long, j string")
    out = {r.id: r for r in io.json_columns(df, "j", "k_").collect()}
    assert (out[1].k_a_b, out[1].k_c, out[2].k_other_clicks, out[3].k_c) == (1.0, 2.5, 7.0, None)


def test_platform_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "ig"), (2, "ig"), (3, "fb")], "id long, platform string")
    assert {r.platform: r.n_rows for r in io.write_by_platform(df, f"{tmp_path}/p").collect()} == {"ig": 2, "fb": 1}
    assert spark.read.parquet(f"{tmp_path}/p").filter("platform = 'ig'").count() == 2
    assert json.loads(io.summary_json(df, {"n": F.count(F.lit(1)), "x": F.max(F.lit(None).cast("long"))}).first().summary) == {"n": 3, "x": None}


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    q = windows.sliding_counts(stream).writeStream.outputMode("complete").format("memory").queryName("sliding").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window_start, r.user_id): (r.comment_count, round(r.mean_value, 9)) for r in spark.table("sliding").collect()}
    assert got == {(r.window_start, r.user_id): (r.comment_count, round(r.mean_value, 9)) for r in windows.sliding_counts(ev).collect()}


def test_transcripts_with_hidden_names_and_batches_that_resume(spark, tmp_path):
    for n, t in (("_a.en.vtt", "one"), ("b.txt", "two"), ("_c.en.empty", ""), ("d.en.md", "no")):
        (tmp_path / n).write_text(t)
    assert sorted((r.id, r.text) for r in io.texts(spark, str(tmp_path)).collect()) == [("a", "one"), ("b", "two"), ("c", "")]
    from pyspark.sql import functions as F

    df = spark.range(50)
    assert io.write_in_batches(df, f"{tmp_path}/out", F.col("id"), 3).count() == 50
    kept = io.write_in_batches(df.filter("id < 0"), f"{tmp_path}/out", F.col("id"), 3)  # all batches are complete, so none is done again
    assert sorted(r.id for r in kept.select("id").collect()) == list(range(50))


def test_csv_with_byte_order_mark(spark, tmp_path):
    import glob

    io.write_csv(spark.createDataFrame([("1", "x")], "id string, text string"), f"{tmp_path}/c", single=True, bom=True)
    (path,) = glob.glob(f"{tmp_path}/c/*.csv")
    assert open(path, "rb").read() == "\ufeffid,text\n1,x\n".encode()
