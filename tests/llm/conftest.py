import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, print int, row int, key int, shard string"
TEXT = " ".join(f"word{i}" for i in range(80))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t", "en", None, 4),
    (4, "one two three", "en", "a", 13),
    (5, TEXT, "en", "a", len(TEXT)),
    (6, TEXT, "de", "b", len(TEXT)),
    (6, TEXT, "de", "b", len(TEXT)),
    (7, "a b " * 30_000, "en", "b", 120_000),
    (8, "é " + TEXT + " mail me@example.com +1 (555) 123-4567", "fr", "c", 9),
]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in ROWS], SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
