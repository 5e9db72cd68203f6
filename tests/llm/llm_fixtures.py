"""Fixtures of these tests (not a conftest: the tests beside this folder import theirs by that name)."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = "all work and no play " * 30_000
ODD = [(1, "the same text of six words", "a"), (2, None, "a"), (3, "", None), (4, LONG, "a"), (5, "x" * 200_000, "b"),
       (6, "the same text of six words", None), (7, "one", "b"), (8, " \t\n ", "b"), (9, "ONE", "c"),
       (10, "ünïcode 日本語 😀 \x00 end", "c"), (11, "the same text of seven words", "a"), (11, "the same text of seven words", "a"),
       (None, "without an id", "a"), (None, "without an id", "a")]
#: Names that operators use inside.
EXTRA = ("n", "label", "rep", "score", "row", "key", "h", "digest", "size", "words", "sketch", "mixed", "copies", "shard", "target")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and extra columns."""
    rows = [(*r, *[f"{e}{i}" for e in EXTRA]) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{e} string" for e in EXTRA))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
