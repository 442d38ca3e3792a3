import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, key long, `class` int, node long, c0 string, size int, `_copy` int"

LONG = "lorem ipsum dolor sit amet " * 9_000 + "the end"


def document(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), "x", 1, 2, 3, "y", 4, 5)


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        document(1, "one two three four five six"),
        document(2, "one  two\tthree four five six"),
        document(3, None, None),
        document(4, ""),
        document(5, " \n "),
        document(6, LONG),
        document(7, LONG, "b"),
        document(8, "ein Wort, día, 日本 \U0001f600", "b"),
        document(8, "ein Wort, día, 日本 \U0001f600", "b"),
        document(None, "no id here", None),
        document(9, "x" * 5_000, ""),
        (10, "all other columns null", None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
