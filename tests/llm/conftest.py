import pytest

#: Columns of documents, and others whose names the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, p double, grp int, key long, word long, own int, "
    "kind string, pos int, match string, length long, offset long, sig binary, `a.b` string"
)
LONG = "very long text of many words, and again. " * 5000


def _row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, 3.0, 4, 5, 6, 7, "k", 8, "m", 9, 10, b"x", "dot")


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, equal texts, repeated rows and clashing columns."""
    rows = [
        _row(1, "the cat sat on the mat"),
        _row(2, None),
        _row(3, ""),
        _row(4, LONG),
        _row(5, "the cat sat on the mat", None, None),
        _row(6, "the cat sat on the mat"),
        _row(6, "the cat sat on the mat"),
        _row(7, "A\n\n\nB \t c\x00d é 漢字 😀  x\r\n"),
        _row(8, "one", "fr", "s2"),
        _row(9, " ", "fr", "s2"),
        _row(10, "1 2 3 !!", "de", None),
        _row(None, "a text without number", None, "s2"),
        _row(None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")
