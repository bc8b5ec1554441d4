import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score STRING, size STRING, `odd.name` STRING"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) with extra columns, two of them named like operator results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] is not None else None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    return make_docs(
        [
            (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (None, "one two three four", "en", "b"), (4, "one two three four", "en", "b"),
            (4, "one two three four", "en", "b"), (5, "x" * 300_000, None, "c"), (6, "word " * 60_000, "de", None), (7, "Ünïcode – ß <|endoftext|> 漢字 ١٢٣", "fr", "é"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
