import pytest
from llm_texts import prose

from corpusloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g", 4)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that operators use themselves."""
    long = prose(1, 60_000)
    rows = [(1, None, "en", 1), (None, "some text here", "en", 2), (2, "", "en", 3), (3, long, "en", 4), (4, "one", None, 5), (5, prose(2, 200), "en", 6), (5, prose(2, 200), "en", 6), (6, prose(2, 200), "de", None), (7, "…!?", "de", 8), (8, "İSTANBUL ığüşöç Straße naïve 漢字 🎉 " * 10, "tr", 9)]
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "doc_id bigint, text string, lang string, n_chars bigint, bands string, block string, hi int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, n_chars bigint")
