"""Small tables with awkward rows, shared by the tests of the text operators."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and{i % 31}." for i in range(20_000))
COMMON = "the quick brown fox jumps over the lazy dog while " * 4
# Names that operators use inside.
CLASHING = ("key", "fp", "component_id", "kept", "slot", "place", "src", "row", "w", "part", "score")

DOCS = [
    (1, COMMON + "first", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "de", "b", 3),
    (5, COMMON + "first", "en", "a", 10),
    (5, COMMON + "first", "en", "a", 10),
    (5, "another text of the same id", "en", "b", 5),
    (6, "two words", "fr", None, 2),
    (None, "no id here " + COMMON, "en", "a", 7),
    (None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Ünï çödé — “quotes” & <tags> </s>[INST] 日本語 \\ \\n \U0001f600 x", "xx", "c", 1),
    (9, "line one here\nline one here\n\nline two\nline one here\n", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns."""
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    """As in the tables; some without a value, some twice."""
    rows = [(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (7, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
