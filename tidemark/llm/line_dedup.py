"""Lines that many documents share: explode, hash, count documents, drop, reassemble.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines except
those of the largest doc_id that holds the key. The rest is joined in its old order.

Defined cases: a null or empty text is one empty line, its result the empty string. A document is
a doc_id: rows that repeat an id count once, and each keeps or loses its own lines by the same
rule. Rows without an id count as one document below all others. Keys are compared by two
independent 64-bit hashes. Nothing is gathered beyond one document's own line numbers; a key in a
third of all documents is pre-aggregated before its count, and the join that marks its lines can
be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, checkpointed, text_or_empty

MIN_CHARS, MIN_DOCS = 40, 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    return F.transform(_lines(ascii_lower(text)), lambda x: F.btrim(x, F.lit(WHITE)))


def _numbered(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: document, its text's hash, line number, key hashes."""
    text = text_or_empty(text_col)
    return (
        docs.select(F.col(id_col).alias("ld_id"), F.xxhash64(text).alias("ld_row"), F.posexplode(_keys(text)).alias("ld_pos", "ld_key"))
        .filter(F.char_length("ld_key") >= min_chars)
        .select("ld_id", "ld_row", "ld_pos", F.xxhash64("ld_key").alias("ld_a"), F.xxhash64(F.lit("line"), F.col("ld_key")).alias("ld_b"))
    )


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of the keys in at least min_docs documents: ld_a, ld_b, ld_docs, ld_keep."""
    pairs = _numbered(docs, id_col, text_col, min_chars).select("ld_a", "ld_b", "ld_id").distinct()
    return pairs.groupBy("ld_a", "ld_b").agg(F.count(F.lit(1)).alias("ld_docs"), F.max("ld_id").alias("ld_keep")).filter(F.col("ld_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text that is left, and n_lines and n_dropped (columns of these names are replaced)."""
    # Cut off from its aggregation, so that the join below may broadcast it if it turns out small, or split a hot key.
    shared = checkpointed(shared_lines(docs, id_col, text_col, min_chars, min_docs))
    drops = (
        _numbered(docs, id_col, text_col, min_chars)
        .join(shared, ["ld_a", "ld_b"])
        .filter(~F.col("ld_id").eqNullSafe(F.col("ld_keep")))
        .groupBy("ld_id", "ld_row")
        .agg(F.collect_set("ld_pos").alias("ld_drop"))
    )
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("ld_in"), F.col(id_col).alias("ld_doc"), text.alias("ld_text"), F.xxhash64(text).alias("ld_hash"))
    # Built in memory from one partition's line numbers, so the texts are moved but not sorted.
    marked = rows.join(drops.hint("shuffle_hash"), F.col("ld_doc").eqNullSafe(F.col("ld_id")) & (F.col("ld_hash") == F.col("ld_row")), "left")
    # The generator keeps the split array as a column, so that the lambda below doesn't split again for each line.
    split = marked.select("ld_in", "ld_text", "ld_drop", F.explode(F.array(_lines(F.col("ld_text")))).alias("ld_lines"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("ld_lines") - 1), F.col("ld_drop")), lambda i: F.get(F.col("ld_lines"), i))
    out = split.select(
        "ld_in",
        F.when(F.col("ld_drop").isNull(), F.col("ld_text")).otherwise(F.array_join(left, "\n")).alias("ld_text"),
        F.size("ld_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("ld_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    taken = {text_col.lower(), "n_lines", "n_dropped"}
    first = [F.col("ld_text").alias(c) if c.lower() == text_col.lower() else F.col(f"ld_in.`{c}`").alias(c) for c in docs.columns if c.lower() not in taken - {text_col.lower()}]
    return out.select(*first, "n_lines", "n_dropped")


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})
), k AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, (hot.key IS NOT NULL AND k.doc_id <> hot.keep) AS dropped FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
FROM m GROUP BY doc_id
"""


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({ORACLE.format(docs='documents')})"
