import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside or make.
        *[T.StructField(n, T.StringType()) for n in ("id", "size", "token", "n_words", "score", "kind", "grp", "train", "rep")],
    ]
)

SF = "/root/testdata/sf0.001"


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), *["x"] * 9)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    line = "the quick brown fox jumps over the lazy dog and runs into the dark wood before night "
    rows = [
        document(1, line * 3), document(2, line * 3), document(2, line * 3), document(3, ""), document(4, None),
        document(5, " \t\n\r "), document(6, "word"), document(7, "ünïcode Straße — 漢字 données", None, None),
        document(8, "!!! ### %%% 12345"), document(9, "the idiot scum " + line, "de", "b"),
        document(10, " ".join(f"w{i % 977}" for i in range(60_000))), document(None, line), document(None, None, None, None),
        document(11, "a b   c d x  y"), (12, None, None, None, None, *[None] * 9), document(-5, line + "tail"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, None, None), (6, 0, 0), (9, 1, 1), (99, 0, 1), (None, 1, 1), (3, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
