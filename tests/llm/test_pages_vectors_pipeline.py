"""HTML extraction, nearest neighbours, and the pipeline as a whole."""

import glob
import html
import os
import re

import numpy as np
import pytest

from tidemark.llm import html_extract, queries, vector_tree

DATA = "/root/testdata/sf0.001"
P = "This paragraph, which is part of the article, has enough words and commas to be counted, as it should."


def page(body):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head</h1><p>{P}</p><p>Short.</p></article><footer>f</footer>",
        f"<header><h2>Site</h2></header><div id=content><h1>Head</h1><p>{P}</p><p>Short.</p></div><div class='sidebar'><p>{P}</p></div><div id='comments'><p>Nice, really, truly!</p></div>",
        f"<div role=navigation>menu</div><main><div class=ad>Buy, now, here.</div><h1>Head</h1><p>{P}<p>Short.<form><p>Your mail</p></form></main><aside>{P}</aside>",
        f"<div class='cookie-notice'>{P[:40]}</div><section><h1>Head</h1><div><p>{P}</p><p>Short.</p></div></section>",
        f"<article><h1>Head</h1><p><b>{P}<p>Short.</article><div style='display:none'>{P}</div><div hidden>{P}</div>",
    ],
)
def test_main_text_of_layouts(body):
    assert html_extract.extract(page(body)) == f"Head\n\n{P}\n\nShort."


def test_html_details():
    x = html_extract.extract
    assert x(None) == x("") == x("  ") == x("<html></html>") == ""
    assert x(page(f"<article><p>a &lt;b&gt; &amp;amp;\n\n c&nbsp;d &eacute; &#8364;</p><p>{P}</p></article>")).startswith("a <b> &amp; c d é €\n\n")
    assert x(page(f"<article><p>one<br>two <i>th</i>ree</p>{P}<ul><li>x<li>y</ul></article>")) == f"one two three\n\n{P}\n\nx\n\ny"
    assert x("<div>" * 3000 + P + "</div>" * 3000) == P
    assert x("<p>" + P + "<!-- hidden --><p unclosed " + "x" * 1000) == P
    long = " ".join(["word, and"] * 50_000)
    assert x(page(f"<article><p>{long}</p></article>")) == long


def test_html_on_pages(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r for r in html_extract.op7_html_extract(spark, DATA).collect()}
    assert rows.keys() == got.keys()
    for i, h in rows.items():
        article = re.search("<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[i].text == "\n\n".join(b for b in blocks if b) and got[i].n_chars == len(got[i].text)


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "u", f"<p>{P}", None)], "page_id long, url string, html string, text string")
    out = html_extract.main_text(df)
    assert out.columns == ["page_id", "url", "text"] and sorted((r.page_id, r.text) for r in out.collect()) == [(1, ""), (1, ""), (2, P)]
    assert html_extract.main_text(df.limit(0)).count() == 0


def brute_top(ids, x, is_query, k):
    out = {}
    for i in np.flatnonzero([is_query(v) for v in ids]):
        s = vector_tree.scores(np.repeat(x[i : i + 1], len(x), axis=0), x)
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[i])] = (ids[keep][order].tolist(), s[keep][order].tolist())
    return out


@pytest.mark.parametrize("shape", ["clusters", "copies", "few", "lengths"])
def test_vector_search_recall(spark, shape):
    rng = np.random.default_rng(9)
    n = 15 if shape == "few" else 3000
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))
    if shape == "copies":
        x[: n // 3] = x[0]
    if shape == "lengths":
        x *= rng.lognormal(0, 1, (n, 1))
    x = x.astype(np.float32)
    ids = np.arange(n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in vector_tree.search(df, lambda c: c % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_top(ids, x.astype(np.float64), lambda v: v % 20 == 0, 20)
    assert got.keys() == want.keys()
    hit = 0
    for q, (best, s) in want.items():
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, min(20, n - 1) + 1))
        hit += len({v for _, v, _ in rows} & set(best))
        if shape == "copies" and q < n // 3:
            assert [v for _, v, _ in rows] == best  # ties to the smaller id
    assert hit / sum(len(b) for b, _ in want.values()) >= 0.9


def test_vector_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (40, [0.0, 0.0]), (8, []), (None, [9.0, 9.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vector_tree.search(df, lambda c: c % 20 == 0).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 7, 2.0), (0, 3, 20, 0.0), (20, 1, 7, 2.0), (20, 2, 7, 2.0), (20, 3, 0, 0.0), (20, 4, 0, 0.0)]
    assert vector_tree.search(df.limit(0), lambda c: c % 20 == 0).count() == 0
    assert vector_tree.search(df.filter("vec_id = 2"), lambda c: c % 20 == 0).count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    run = queries.queries()
    for name, sql in queries.oracle_sql().items():
        got, want = run[name](spark, DATA).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(want.columns)
        a, b = (x[cols].astype(str).sort_values(cols, ignore_index=True) for x in (got, want))
        assert a.equals(b), name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            kept[name] = out
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]
    ids = lambda n: {r.doc_id for r in kept[n].select("doc_id").collect()}
    assert ids("line_dedup") == ids("quality_rules") and ids("simhash") < ids("line_dedup") and ids("mixing") <= ids("simhash")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    sound = {r.doc_id for r in labels.filter("quality = 1").filter(F.size(F.split("text", r"\s+")) >= 60).collect()}
    assert sound <= ids("quality_rules")
    texts = {r.doc_id: (r.text, r["count"]) for r in kept["mixing"].groupBy("doc_id", "text").count().collect()}
    rows = docs.collect()
    once = {d: t for d, (t, n) in texts.items() if n == 1}
    alone = [r for r in rows if r.doc_id in once]
    assert {r.doc_id for r in rows} == texts.keys() and max(n for _, n in texts.values()) <= 2
    tokens = {d: sum(r.length for r in alone if r.doc_id == d) for d in once}
    assert all(r.doc_tokens == tokens[r.doc_id] for r in alone)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "start", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.ids_crc32) for r in rows)


def test_pipeline_stages_on_odd_and_empty_input(spark, odd_docs, no_docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    odd = odd_docs.withColumns({c: F.lit("mine") for c in ("copy", "cp_copy", "N_lines", "text_licence", "root", "qr_row")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert all(r["copies"] == "mine" and r["cp_copy"] == "mine" and r["copy"] == "mine" and r["fp"] == "mine" and r["start"] == "mine" for r in rows), name
        if name == "quality_rules":
            assert not rows  # too short, or the same words over and over
        if name == "line_dedup":
            assert len(rows) == odd.count() and all(r.text is not None and r.n_chars == len(r.text) for r in rows)
        if name == "simhash":
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 6, 7]
        if name == "mixing":
            assert max(rows.count(r) for r in rows) <= 2 * odd.count()
        assert stage(spark, no_docs, DATA).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, DATA).collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_id is None) >= 2 and len([r for r in packed if r.start == 0]) == odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, DATA).count() == 0
