import pandas as pd
import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i} and" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while seventeen patient engineers measure every single step of the work. "


def rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    return [
        (1, PROSE * 5, "en", "a", 1), (2, PROSE * 5, "en", "b", 1), (2, PROSE * 5, "en", "b", 1), (3, None, None, None, None),
        (None, "nameless text without an id", "en", "a", 2), (4, "", "en", "c", 0), (5, "   \n\t ", None, "c", 0), (6, LONG, "de", "d", 9),
        (7, "½ 123 !!", "en", "e", 3), (8, "eins zwei drei\neins zwei drei\nvier.", "de", None, 5), (9, "ÀÉ ñandú 日本語 ▁ x\r\ny", "es", "f", 4),
        (10, "x" * 500, "en", "a", 500), (None, None, None, None, None),
    ]


DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark, folder):
    return pd.DataFrame(spark.read.parquet(f"{folder}/documents.parquet").toPandas()).sort_values("doc_id")
