import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents-like frame from (id, text) rows; further columns clash with names used inside."""

    def build(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            for c in ("key", "h", "pos", "size", "text_sha256", "component", "score", "_text", "_h", "shard", "u", "length", "lang", "_id", "_sha", "_gone", "_hit", "_digest", "_t", "cid", "rep", "text_h", "_text_h"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return build


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Two words"), (5, "Two words"), (None, "a b c d e f g"), (6, "x" * 50_000), (7, "word " * 20_000), (8, "a\nb\n\nc\n"), (9, " É ñ\U0001f600  A"), (10, None)]


@pytest.fixture(scope="session")
def odd():
    return ODD
