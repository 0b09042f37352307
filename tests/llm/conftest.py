import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, id int, `weird na``me` int"


def plain_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; and column names that operators use themselves."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from it in the end " * 12
    rows = [
        (1, prose, "en", "a", 5),
        (2, prose, "en", "a", 5),
        (2, prose, "en", "a", 5),
        (3, prose + "one more", "en", None, None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 3),
        (7, "ein", "de", "b", 3),
        (8, LONG, "en", "c", len(LONG)),
        (9, "x" * 60_000, None, "c", 60_000),
        (None, "nobody knows the number of this text", "en", "c", 36),
        (None, None, None, None, None),
        (10, "<|endoftext|> \\ <|im_end|> É é ﬁ 日本語 😀", "fr", "\U00010000", 9),
        (11, "nobody knows the number of this text", "en", "c", 36),
    ]
    return [(*r, 0.5, "own", 7, 1) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(plain_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
