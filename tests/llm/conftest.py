import pytest
from pyspark.sql import types as T

#: Nulls in each column, empty and white texts, ties and repeated rows, a clashing extra column.
TRICKY = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
    (2, "alpha beta gamma delta epsilon eta", "en", None, None, None),
    (3, None, None, "b", 0, "y"),
    (4, "", "de", "b", 0, None),
    (5, " \n\t  ", "de", "b", 5, None),
    (6, "a  b   c ▁x▁\n\n<|endoftext|> </s>  ", "fr", "a", 1, "z"),
    (7, "word " * 9000, "fr", "a", 1, "z"),
    (8, "w" * 6000, "fr", "", 1, "z"),
    (None, "no id at all", "es", "c", 1, "z"),
    (9, "CafÉ \U0001f600 été 　wide", "es", "c", 1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string"


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(TRICKY, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
