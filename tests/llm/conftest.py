import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null ids and other columns, ties, a repeated row, a long text, extra columns with clashing names."""
    long = " ".join(f"word{i % 997} the of," for i in range(20_000))
    rows = [
        (1, "The of and to a in is that it for was on with as be by this are " * 5, "en", "s", 1),
        (2, None, "en", "s", None),
        (3, "", None, None, 0),
        (4, " \t\n\x0b\f\r ", "xx", "s", 7),
        (None, "no id here", "en", "s", 10),
        (None, None, None, None, None),
        (5, "same text twice", "en", "s", 15),
        (6, "same text twice", "en", "t", 15),
        (6, "same text twice", "en", "t", 15),
        (7, long, "en", "s", len(long)),
        (8, "Grüße aus Köln \U0001f600 l'été\u00a0\u3000x  y", "de", "s", 30),
        (9, "x" * 30_000, "fr", "s", 30_000),
        (10, "a\nb\na\n\na\n", "es", "s", 8),
    ]
    out = spark.createDataFrame(rows, DOCS)
    for name in ("Kept", "fp", "h", "words", "score", "label", "path", "n", "_q_t", "_evidence"):
        from pyspark.sql import functions as F

        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
