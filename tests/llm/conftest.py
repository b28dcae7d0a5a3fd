import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; ids are positions unless given."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, repeats, very long texts and texts without words."""
    words = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
    return [None, "", " \n\t\n ", "one", "one", "a b c", "ä ö ü ß " * 30, words, words, "x" * 100_000, words + " tail", "\n".join(["same line that repeats here"] * 5)]
