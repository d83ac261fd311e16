import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, slot long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty and blank texts, a long text, ties and repeated rows, columns with names the operators use."""
    text = "The same words stand here again and again, and once more the same words stand here."
    return [
        (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, None, None), (3, " \n\t ", "en", "a", 4, "x", 2), (4, "one", "de", "b", 3, "x", 3),
        (5, text, "en", "a", len(text), "x", 4), (6, text, "en", None, len(text), "x", 5), (6, text, "en", None, len(text), "x", 5), (None, text, None, "b", None, None, None),
        (7, "wort " * 3000 + "ende", "de", "b", 0, "x", 6), (8, "x" * 5000, None, "b", 5000, "x", 7), (9, "ünïcode 文字 " + " " + " ☃" * 20, "fr", "c", 1, "x", 8),
        (10, text.upper(), "en", "c", len(text), "x", 9),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
