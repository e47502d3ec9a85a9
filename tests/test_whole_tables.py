"""Registered queries read whole tables and whole texts."""

import hashlib
import random

import duckdb

from tidemark.operators import identity
from tidemark.plans import registry


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_fuzzy_name_match_takes_every_part(spark, tmp_path):
    words, kinds = ["small ring", "red widget", "blue bolt", "hot gear", "old plate", "cold gizmo"], ["ECONOMY", "SMALL", "STANDARD", "LARGE"]
    r = random.Random(8)
    parts = [(i, r.choice(words), f"Brand#{r.randint(1, 25)}", r.choice(kinds)) for i in range(370, 470)]
    d = stored(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string")
    names = [(i, " ".join(n).lower()) for i, *n in parts]
    b = [(i, n.replace("a", "")) for i, n in names if i % 2 == 1]
    want = {}
    for i, n in names:
        if i % 2 == 0 and n not in {m for _, m in b}:
            s, j = max((identity.indel_ratio(n, m), -j) for j, m in b)
            if s >= 85:
                want[i] = (-j, round(s, 4))
    got = {x.a_id: (x.b_id, round(x.score, 4)) for x in registry.queries()["fuzzy_name_match"](spark, d).collect()}
    assert got == want and max(got) > 460 and max(j for j, _ in got.values()) >= 400


def test_social_clean_takes_whole_texts(spark, tmp_path):
    head = "plain words without any marks " * 4
    d = stored(spark, tmp_path, "documents", [(1, head + "@ann  looove #pizza http://x.y"), (2, head + "nothing here"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x.cleaned_md5 for x in registry.queries()["social_clean"](spark, d).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    start = "see [URL] tag " + head
    assert got == {1: md5(start + "[UTENTE] loove pizza [URL]"), 2: md5(start + "nothing here"), 3: None}


def test_emoji_word_counts_takes_whole_texts(spark, tmp_path):
    head, grin, joy = "plain words without any marks " * 4, "\U0001f600", "\U0001f602"
    texts = {1: head, 2: head + grin + joy, 3: grin + " a " + head + grin + grin + joy + grin + "b " + joy, 4: ""}
    d = stored(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")

    def brute(text):
        runs = words = units = 0
        for chunk in text.replace("a ", f"a {grin}{grin}\U0001f44d\U0001f3fd ").split():
            kinds = ["" if ch.isalnum() else "+" if ch == "\U0001f3fd" else ch for ch in chunk]
            kinds = [k for k in kinds if k != "+"]
            units += sum(k != "" for k in kinds)
            for i, k in enumerate(kinds):
                before = kinds[i - 1] if i else None
                runs += before is None or (k == "") != (before == "")
                words += k != before
        return runs, words, units

    got = {x.doc_id: (x.runs, x.words, x.units) for x in registry.queries()["emoji_word_counts"](spark, d).collect()}
    assert got == {i: brute(t) for i, t in texts.items()} and got[3][2] == 9


def test_csv_round_trip_keeps_every_character(spark, tmp_path):
    ends = ["", " ", "x ", " x", "x\n", "\r", "a\rb", "x\r\n", "\t", "x\x0c", "\x01", "\x00", 'a\x00"b', 'x\x00\n"\x00"', '"', '""', 'x\\"', ",", "\ufeffx", "\u00a0", None]
    rows = [(i, t, "web", 1) for i, t in enumerate(ends)] + [(100 + i, "t", t, None) for i, t in enumerate(ends)] + [(None, "t", "web", 1)]
    d = stored(spark, tmp_path, "documents", rows, "doc_id long, text string, source string, n_chars long")
    got = [tuple(x) for x in registry.queries()["csv_round_trip"](spark, d).select("doc_id", "source", "text_md5").collect()]
    want = [(i, source, None if t is None else hashlib.md5(('a "quoted", ' + t).encode()).hexdigest()) for i, t, source, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_transcript_clean_takes_whole_texts(spark, tmp_path):
    cleaned = {
        "plain": "plain end", "card 4088": "card  end", "x\n": "x  end", " x": "x end", "": "end", "\n": "end", None: "end", "a <b": "a <b end", "a <": "a < end", "<i>a</i> b": "a b end",
        "a\nwebvtt: b\nc": "a webvtt b c end", "WEBVTT\n1\n00:00:01.000 --> 00:00:02.000\nx": "WEBVTT . --> . x end", "\u00a0 x": "x end", "12:30\n7\n": "end",
    }
    d = stored(spark, tmp_path, "documents", list(enumerate(cleaned)), "doc_id long, text string")
    got = {x.doc_id: x.cleaned_md5 for x in registry.queries()["transcript_clean"](spark, d).collect()}
    assert got == {i: hashlib.md5(c.encode()).hexdigest() for i, c in enumerate(cleaned.values())}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
        assert got == dict(con.execute(registry.oracle_sql()["transcript_clean"]).fetchall())
