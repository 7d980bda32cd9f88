import re

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, shard int, slot string, hash int, key string, "
          "n int, line string, found string, _m int, bucket int, node string, failed int, n_words string")
PROSE = " ".join(f"w{i}x" for i in range(60))
LONG = " ".join(f"long{i % 9973}q{i}" for i in range(120_000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), 1, 2, "s", 3, "k", 4, "l", "f", 5, 6, "x", 7, "w")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names the operators use themselves."""
    return spark.createDataFrame([
        row(1, PROSE), row(1, PROSE), row(2, PROSE), row(None, PROSE), row(3, None), row(4, ""), row(5, "\n \t\n", None),
        row(6, LONG, "b"), row(7, "short text", None), row(8, PROSE.replace("w30x", "other"), "é"), row(9, None, None),
    ], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
