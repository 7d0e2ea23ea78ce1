import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, token long, kept boolean, `key` string"


@pytest.fixture(scope="session")
def words():
    return random.Random(5)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with extra columns that clash with names used inside; texts by id."""

    def make(texts, langs=None, sources=None):
        rows = []
        for i, t in texts:
            lang = None if langs is None else langs.get(i)
            source = None if sources is None else sources.get(i)
            rows.append((i, t, lang, source, None if t is None else len(t), 0.5, 7, None, "x"))
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Null and empty texts, a null id, repeated rows, one very long text and odd characters."""
    long = "word " * 200_000 + "licensed under cc by 4.0"
    return documents([(1, None), (2, ""), (3, "  \n\t "), (None, "null id here with words"), (4, long), (5, "same row twice"), (5, "same row twice"), (6, "\0\x7f é𝄞 ünï ߷ ½"), (7, "!!! ... ???")])
