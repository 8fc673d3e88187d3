"""Tables for the operators' tests: small ones with every odd case, and the given ones."""

import os

import pytest
from pyspark.sql import types as T

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("_row", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("toxic", T.StringType()),
    T.StructField("_key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("_size", T.StringType()),
])
WORDS = [f"w{i % 97}é{i % 89}" for i in range(4000)]
LONG = " ".join(f"a{i}" for i in range(120_000))


def documents(spark, rows):
    """A documents table from (doc_id, text, source), with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", s, None, "r", "n", "t", "k", "l", "s") for i, t, s in rows], DOCUMENTS)


ODD = [
    (7, " ".join(WORDS[:300]), "a"), (7, " ".join(WORDS[:300]), "a"),  # a repeated row
    (3, " ".join(WORDS[:300]), "b"),  # a copy
    (4, " ".join(WORDS[:250] + ["changed"] + WORDS[251:300]), None),  # a near copy
    (None, None, None), (5, None, "a"), (6, "", "a"), (8, " \n\t ", "b"), (9, "one", "b"), (10, "one two", "c"), (11, "one two", "c"),
    (None, " ".join(WORDS[500:600]), "a"), (12, " ".join(WORDS[500:600]), "a"),
    (13, "same " * 200, "d"), (14, LONG, "d"), (15, "\U0001f600 \U0001f600 token: abcdefgh12 \x1c x", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
