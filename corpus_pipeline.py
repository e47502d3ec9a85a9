"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each
stage's rows as Parquet to the shared folder and reads them again as the next one's docs. All but the last return the columns of
docs, extra ones included, whatever their names; only text and n_chars are ever computed anew. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, packing, quality_rules, simhash
from tidemark.llm.common import shared_dir

#: The weak-supervision verdict, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """docs as the named columns and a struct of all others, so that no operator's own columns meet theirs."""
    return docs.select(*names, F.struct(F.lit(0).alias("cp_none"), *[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("cp_row"))


def _restored(df: DataFrame, docs: DataFrame, *names: str, **computed: Column) -> DataFrame:
    """The columns of docs from _carried(docs, *names), some of them computed."""
    return df.select(*[computed[c].alias(c) if c in computed else F.col(c if c in names else f"cp_row.`{c}`").alias(c) for c in docs.columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the weighed rules reject go: null, empty and very short texts too. Repeated rows are judged alike."""
    return quality_rules.keep_sound(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by many documents are cut out of the text; n_chars follows. A null text becomes the empty one; rows without doc_id count as one document."""
    out = line_dedup.dedup_lines(_carried(docs, "doc_id", "text"))
    return _restored(out, docs, "doc_id", "text", n_chars=F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that five-word shingles link at a similarity of 0.8 the document of the smallest id stays, once.

    Texts without words (null ones too) are one group; rows without doc_id stay only where no other of their group has one.
    """
    return simhash.keep_one(docs, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it: not at all, once or twice. A null source is a source; null texts have no words."""
    names = ("doc_id", "text", "source")
    out = mixing.mix(_carried(docs, *names), keep_text=True).filter(F.col("copies") > 0)
    return _restored(out.withColumn("cp_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs, *names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences. A null or empty text has its end id alone; repeated rows are packed each, and a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", filter_quality),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(at := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(at)
    return docs
