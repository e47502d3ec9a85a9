import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns whose names operators also use."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.\nsecond line", "en", "a", 10), (1, "The quick brown fox jumps over the lazy dog and runs away.\nsecond line", "en", "a", 10),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t\n ", "en", "b", 5), (None, "no id at all, this one", None, "b", None), (None, None, None, None, None),
        (5, long, "en", "a", len(long)), (6, "Ünïcödé ŁŻ ß İ 中文   x", "de", "é", 3), (7, "x", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({"n_lines": F.lit("mine"), "size": F.lit("mine"), "fp": F.lit("mine"), "score": F.lit(1), "N_Dropped": F.lit(2), "quality": F.lit("mine"), "copies": F.lit("mine"), "start": F.lit("mine"), "count": F.lit(0)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
