"""Licence texts and notices by a canonical digest.

A text is brought to a canonical form: A-Z in lower case, copyright lines gone, everything but letters and digits
turned into single spaces, spelling variants of one word made equal. Its md5 is looked up among the digests of known
licences by a hash join; equal digest, same licence. What is looked up is a whole text and each whole line
(a notice such as "Released under the MIT License." stands on its own line), never a part of a line.

The table of known texts is a parameter (name, kind, text) of at most MAX_KNOWN rows, so it is broadcast; a larger one is
joined by shuffle. Defined cases: null and empty texts match nothing; rows that repeat an id give a row
each; ``notices`` counts every matching line; a known text that is empty in canonical form matches nothing. A copyright line without a year goes if it has a (c) or ©; without either it
may be part of a sentence and stays. A claim goes with all of its line, so a text wrapped anew matches if its claims keep lines of their own.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, text_or_empty

MAX_KNOWN = 10_000
#: Words that licences spell in more than one way, and their canonical spelling.
SPELLINGS = [("licence", "license"), ("licensed", "license"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("noninfringement", "non infringement"), ("https", "http"), ("copyrights", "copyright"), ("per cent", "percent"), ("owner", "holder"), ("owners", "holders"), ("favour", "favor"), ("recognised", "recognized"), ("authorised", "authorized"), ("v 2 0", "version 2 0")]

#: Well-known short licence texts and notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


#: The titles that stand before the short texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"], "Unlicense": ["The Unlicense", "Unlicense"],
}
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"


def full_texts() -> list[tuple[str, str]]:
    """name, text: whole licences, with and without title, "All rights reserved." and what follows the end of the terms."""
    stored = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
    short = TEXTS | {"BSD-3-Clause": TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS", _NO_ENDORSEMENT + "THIS SOFTWARE IS"), "Unlicense": stored["Unlicense"]}
    out = list(TEXTS.items()) + list(stored.items())
    end = "END OF TERMS AND CONDITIONS"
    out += [(n, t[: t.index(end) + at]) for n, t in stored.items() if end in t for at in (0, len(end))]
    short |= {f"{n} ": re.sub(r"(?m)^[0-9]\. ", "", t) for n, t in short.items() if n.startswith("BSD")}  # with bullets in place of numbers
    return out + [(n.strip(), f"{title}\n{rights}\n{t}") for n, t in short.items() for title in ["", *TITLES[n.strip()]] for rights in ("", "All rights reserved.")]


def known_licences(spark: SparkSession) -> DataFrame:
    rows = [(n, "text", t) for n, t in full_texts()] + [(n, "notice", t) for n, ts in NOTICES.items() for t in ts]
    return spark.createDataFrame(rows, "name string, kind string, text string")


#: A line of which nothing but a copyright claim is left.
_CLAIM = r"^[^a-z0-9\n]*(?:copyright(?: \(c\))?|\(c\))[^a-z0-9\n]*[0-9]{4}[^\n]*$"
#: One without a year.
_CLAIM_NO_YEAR = r"^[^a-z0-9\n]*copyright *(?:\(c\)|©)[^\n]*$"
_GAP = r"[^\p{L}\p{N}]+"


def _words(line: Column) -> Column:
    """A lower-case line's words with two spaces between, so that two spellings in a row share none; a claim has none."""
    return F.trim(F.regexp_replace(F.when(line.rlike(_CLAIM) | line.rlike(_CLAIM_NO_YEAR), F.lit("")).otherwise(line), _GAP, "  "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text_or_empty(text)), "\n", -1), _words)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), "  ")


def _spelled(words: Column) -> Column:
    c = F.concat(F.lit("  "), words, F.lit("  "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """Equal for texts that differ in case, punctuation, copyright lines and spelling."""
    return _spelled(_whole(_lines(text)))


#: Each text of known_licences() has one of these in its words, in either spelling, so a unit that has none matches none.
HINT = "licen[cs]e|permission|redistribut|public  domain|released  under"


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_licence (of the whole text, or null), notices (matching lines), licences (their names, sorted, distinct)."""
    hint = F.col("lc_unit").rlike(HINT) if known is None else F.col("lc_unit") != ""
    known = known_licences(docs.sparkSession) if known is None else known
    form = known.select(canonical(F.col("text")).alias("lc_form"), F.col("name").alias("lc_name")).filter((F.col("lc_form") != "") & F.col("lc_name").isNotNull())
    table = form.groupBy(F.md5("lc_form").alias("lc_digest")).agg(F.min("lc_name").alias("lc_name"))
    if known.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN:
        table = F.broadcast(table)
    text = text_or_empty(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("lc_text"), F.xxhash64(text).alias("lc_row"))
    # The generators keep the lines, and then each unit, as columns; else every use below would work on the text again.
    lines = rows.select("doc_id", "lc_row", F.explode(F.array(_lines(F.col("lc_text")))).alias("lc_lines"))
    units = lines.select("doc_id", "lc_row", F.posexplode(F.concat(F.array(_whole(F.col("lc_lines"))), F.col("lc_lines"))).alias("lc_at", "lc_unit"))
    named = units.filter(hint).select("doc_id", "lc_row", "lc_at", F.md5(_spelled(F.col("lc_unit"))).alias("lc_digest")).join(table, "lc_digest")
    # Sets, so that repeated rows of a document don't count its lines twice; a set holds one document's own lines.
    found = named.groupBy("doc_id", "lc_row").agg(
        F.max(F.when(F.col("lc_at") == 0, F.col("lc_name"))).alias("text_licence"),
        F.size(F.collect_set(F.when(F.col("lc_at") > 0, F.col("lc_at")))).cast("long").alias("notices"),
        F.array_join(F.array_sort(F.collect_set("lc_name")), ",").alias("licences"),
    ).withColumnsRenamed({"doc_id": "lc_id", "lc_row": "lc_hash"})
    met = rows.select("doc_id", "lc_row").join(found, F.col("doc_id").eqNullSafe(F.col("lc_id")) & (F.col("lc_row") == F.col("lc_hash")), "left")
    return met.select("doc_id", "text_licence", F.coalesce("notices", F.lit(0).cast("long")).alias("notices"), F.coalesce("licences", F.lit("")).alias("licences"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    c = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for claim in (_CLAIM, _CLAIM_NO_YEAR):
        c = f"regexp_replace({c}, {_sql_text('(?m)' + claim)}, '', 'g')"
    c = f"'  ' || trim(regexp_replace({c}, {_sql_text(_GAP)}, '  ', 'g')) || '  '"
    for a, b in SPELLINGS:
        c = f"replace({c}, {_sql_text(f' {a} '.replace(' ', '  ')[1:-1])}, {_sql_text(f' {b} '.replace(' ', '  ')[1:-1])})"
    return f"md5(trim(replace({c}, '  ', ' ')))"


OP2_SQL = f"""
WITH known(name, text) AS (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in [*full_texts(), *((n, t) for n, ts in NOTICES.items() for t in ts)])}),
k AS (SELECT {_sql_canonical("text")} AS digest, min(name) AS name FROM known GROUP BY 1),
u AS (
  SELECT doc_id, unnest(range(len(us))) AS pos, unnest(us) AS unit
  FROM (SELECT doc_id, list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10))) AS us FROM documents)
), m AS (
  SELECT u.doc_id, u.pos, k.name FROM (SELECT doc_id, pos, {_sql_canonical("unit")} AS digest FROM u) u JOIN k ON u.digest = k.digest
)
SELECT d.doc_id, max(m.name) FILTER (m.pos = 0) AS text_licence, count(m.pos) FILTER (m.pos > 0)::BIGINT AS notices,
       coalesce(array_to_string(list_sort(list(DISTINCT m.name) FILTER (m.name IS NOT NULL)), ','), '') AS licences
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
