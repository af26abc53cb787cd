import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing names."""
    long_text = "word of many " * 40_000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 3, "x", "y", "z"),
        (2, "alpha  beta\tgamma delta epsilon zeta.", "en", "a", 3, "x", "y", "z"),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "x", "y", "z"),
        (5, " \t\n", "de", "b", 0, "x", "y", "z"),
        (None, "nobody knows this id 4111 1111 1111 1111", "en", None, 1, "x", "y", "z"),
        (None, None, None, "a", None, None, None, None),
        (7, long_text, "en", "a", 1, "x", "y", "z"),
        (8, long_text, "en", "c", 1, "x", "y", "z"),
        (9, "ñandú 😀 mail a.b@c.example.org, +1 (234) 555-0101", "es", "c", 1, "x", "y", "z"),
        (9, "ñandú 😀 mail a.b@c.example.org, +1 (234) 555-0101", "es", "c", 1, "x", "y", "z"),
        (10, "12345 !!! 999", "fr", "c", 1, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
