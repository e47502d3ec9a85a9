"""Pages whose text is not in one article element."""

from tidemark.llm import html_extract

LONG = [f"Paragraph {i} tells, at some length, of rivers, hills, towns and the people who live there, year after year, in peace." for i in range(8)]
PS = ["".join(f"<p>{t}</p>" for t in LONG[:4]), "".join(f"<p>{t}</p>" for t in LONG[4:])]


def test_text_in_a_div_beside_teaser_articles():
    cards = "".join(f"<article class='card'><p>A teaser of thirty letters, no {i}.</p></article>" for i in range(3))
    got = html_extract.extract(f"<html><body><div id='story'>{PS[0]}{PS[1]}</div><div class='grid'>{cards}</div></body></html>")
    assert got == "\n\n".join(LONG)


def test_text_in_two_sibling_articles():
    got = html_extract.extract(f"<html><body><div><article>{PS[0]}</article><article>{PS[1]}</article></div></body></html>")
    assert got == "\n\n".join(LONG)


def test_broken_quotes_are_no_text():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    assert html_extract.extract(f"<html><body><article><p class=\"q>{LONG[0]}</p></article></body></html>") == LONG[0]
    assert html_extract.extract(f"<html><body><article>{body}<p title='x>{LONG[1]}</p></article></body></html>") == "\n\n".join([*LONG, LONG[1]])
    assert html_extract.extract(f"<html><body><article>{body}<p data-x='<b>kept</b>'>{LONG[1]}</p></article></body></html>") == "\n\n".join([*LONG, LONG[1]])


def test_pages_keep_their_text_without_article():
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    other = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    same = [html_extract.extract(a) == html_extract.extract(b) for a, b in zip(pages, other)]
    assert sum(same) >= 0.99 * len(same)
