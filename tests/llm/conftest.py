import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, marks string, bands string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with columns whose names clash with those the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), -1, "m", None) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids, texts without letters or words."""
    long = " ".join(f"word{i} again" for i in range(30_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "12 34 !!"), (5, "a b c"), (6, "a b c"), (7, long), (7, long), (8, "x" * 5000), (None, "no id here at all"), (None, None), (9, "żółć \U0001f600 ▁ end"), (10, "[CLS] <|endoftext|> \x85\x1c odd")]
