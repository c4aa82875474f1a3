from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest given documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    prose = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood " * 4
    rows = [
        (1, None, None, None, None),
        (None, "a text without an id " * 20, "en", "s", 3),
        (None, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n ", "en", "s", 4),
        (4, long, "en", None, len(long)),
        (5, prose, "en", "s", len(prose)),
        (6, prose, "de", "t", len(prose)),
        (7, prose, "de", "t", len(prose)),
        (7, prose, "de", "t", len(prose)),
        (8, "é" * 300, "fr", "t", 300),
        (9, "one two", "fr", "t", 7),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    for name in ("score", "label", "size", "shard", "slot", "fingerprint", "uid_", "n_words", "rejected_by", "copies", "token", "key"):
        odd = odd.withColumn(name, F.lit("x"))
    return odd


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
