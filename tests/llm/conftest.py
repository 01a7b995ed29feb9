import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} of line {i}." for i in range(6000))
ROWS = [
    (1, "One text with some words, and then some more of them to come.", "en", "b", 11),
    (2, "One text with some words, and then some more of them to come.", "en", "b", 12),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "a", 3),
    (6, "short", "fr", None, 5),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG + " end", "en", "b", len(LONG) + 4),
    (9, "Éléphants déjà vus\x00 mit Größe 中文字 и слова", "fr", "é", 40),
    (9, "a repeated id with a text of its own that is long enough", "fr", "é", 40),
    (None, "no id but a text with quite a few words in it", "de", "", 1),
    (12, "same " * 60, "en", "a", 300),
    (13, "a b c d e f g h " * 6, "en", "a", 96),
    (14, "One text with some words, and then some more of them to come.", "en", "z", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank, odd and very long texts, ties, repeated rows and clashing column names."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(n, T.IntegerType()) for n in ("part", "row", "score", "fp", "size", "entities", "token", "words")]
    )
    return spark.createDataFrame([(*r, *range(8)) for r in ROWS], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("doc_id < 0")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
