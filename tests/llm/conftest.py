import random

import pytest

#: Texts that any operator must take: null, empty, blank, broken words, ties, repeats, very long.
ODD = [None, "", " ", "\n\n", "a", "A b\tc", "x " * 12, "word " * 30_000, "é世界 😀 <|endoftext|> <s>", " 　", "tie one two three four five six", "tie one two three four five six"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """documents with odd texts, null and repeated ids, repeated rows and clashing names."""
    rows = [(i, t, i, "n", "k") for i, t in enumerate(ODD)]
    rows += [rows[10], rows[1], (None, "a text without id " * 4, 1, "n", "k"), (None, None, 1, "n", "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, g int, sha string, `key` string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string")


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents of the test data."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
