from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
BASE = " ".join(f"base{i}" for i in range(120))


def rows():
    """Nulls in every column, empty, short and very long texts, ties, repeated rows and ids."""
    near = BASE.replace("base60", "other")
    return [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, near, "fr", "b", 2), (4, None, "en", "a", None),
        (5, "", "fr", None, 0), (6, " \t\n", None, "b", 3), (7, "!!! ... 123", "en", "c", 4), (8, LONG, "en", "a", 5), (9, "the cat", "en", None, 6),
        (10, "le chat noir et le chien sont là", "fr", "b", 7), (None, "no id here at all", "en", "a", 8), (None, BASE, None, None, 9), (11, "the dog and the cat are here", "en", "c", 10),
        (12, "THE CAT", "en", "c", 11), (13, "token = \"4bb0c75cc3b0398440b6ca30dd75\" é😀", "en", "c", 12), (14, "le chien et le chat là", "fr", "c", 13), (15, "the cat and a dog", "en", "d", 14),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns whose names the operators use inside."""
    extra = ["size", "shard", "hits", "class", "label", "language", "weight", "mix_hash", "mix_source", "piece", "set", "near_id", "signature", "n_tokens"]
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(c) for c in extra})
