"""Licences as their files have them."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import license_scan


def found(spark, rows):
    return {r.doc_id: (r.text_licence, r.licences) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


def test_whole_files_with_titles_and_claims(spark):
    folder = Path(license_scan.__file__).parent / "licences"
    rows = [(p.stem, p.read_text()) for p in sorted(folder.glob("*.txt"))]
    t = license_scan.TEXTS
    rows += [
        ("MIT", "MIT License\n\nCopyright (c) Microsoft Corporation.\n\n" + t["MIT"]), ("ISC", "ISC License\n\nCopyright (c) 2020, Somebody\n\n" + t["ISC"]),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + t["BSD-2-Clause"]),
    ]
    got = found(spark, rows)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= got.keys()
    assert all(v[0] == k for k, v in got.items()), got
    assert found(spark, [("x", rows[0][1].replace("the", "teh", 1))])["x"][0] is None


def variants():
    t = license_scan.TEXTS
    mit = "MIT License\n\nCopyright (c) 2021 A. Somebody\n\n" + t["MIT"]
    bullets = "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + t["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")
    rows = [("MIT", mit), ("MIT", mit.replace(" ", "  ")), ("MIT", mit.replace(" to ", "\nto ")), ("MIT", mit.upper()), ("BSD-2-Clause", bullets), ("BSD-2-Clause", bullets.replace("copyright holder ", "copyright owner ").replace("COPYRIGHT HOLDER ", "Copyright Owner "))]
    for p in sorted((Path(license_scan.__file__).parent / "licences").glob("*.txt")):
        flow = " ".join(p.read_text().split()) if "GPL" not in p.stem else p.read_text().replace(" ", "  ")  # a claim must keep a line of its own
        rows += [(p.stem, flow), (p.stem, p.read_text().replace("\n", "\r\n")), (None, p.read_text().replace("the", "teh", 1))]
    return rows


def test_wrapped_and_spaced_files(spark):
    rows = [(f"{i} {n}", t) for i, (n, t) in enumerate(variants())]
    got = found(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {f"{i} {n}": n for i, (n, _) in enumerate(variants())}
    assert found(spark, [("a", "so:\nReleased  under CC0 1.0."), ("b", "Released\tunder, CC0 1.0.")]) == {"a": (None, "CC0-1.0"), "b": ("CC0-1.0", "CC0-1.0")}


def test_hint_passes_over_nothing_known(spark):
    known = license_scan.known_licences(spark)
    assert known.filter(~license_scan._whole(license_scan._lines(F.col("text"))).rlike(license_scan.HINT)).count() == 0


def test_spellings_in_a_row_and_empty_forms(spark):
    c = spark.createDataFrame([("licence licence v 2 0",), ("license, license version 2.0",)], "t string").select(license_scan.canonical(F.col("t")).alias("c"))
    assert {r.c for r in c.collect()} == {"license license version 2 0"}
    known = spark.createDataFrame([("empty", "text", "---"), (None, "text", "some words"), ("none", "text", None)], "name string, kind string, text string")
    docs = spark.createDataFrame([(1, ""), (2, "***\n"), (3, "some words"), (4, None)], "doc_id long, text string")
    assert all(r.text_licence is None and r.notices == 0 and r.licences == "" for r in license_scan.scan(docs, known).collect())


def test_sql_gives_the_same(spark):
    import duckdb

    rows = [(i, t) for i, (_, t) in enumerate(variants())] + [(900, None), (901, ""), (902, "x\nReleased under the MIT licence.\n\nSPDX-License-Identifier: MIT"), (903, "Copyright 2020 x\nReleased under the MIT License.")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, text_licence, notices, licences FROM ({license_scan.OP2_SQL}) ORDER BY 1").fetchall()
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
