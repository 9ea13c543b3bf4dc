import pytest

from vistrata.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


DOCS = ("doc_id long, text string, lang string, source string, n_chars long,"
        " digest string, fp string, n long, row string")


@pytest.fixture
def frame(spark):
    """Documents with further columns whose names clash with those used inside."""
    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "y", 7, "z")
                for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCS)
    return make


PROSE = " ".join(f"word{i % 37} other{i % 11} thing{i}" for i in range(80))


@pytest.fixture
def odd_rows():
    """NULLs in every column, empty and long texts, ties and repeated rows."""
    return [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"),
        (3, PROSE.upper(), "en", None), (4, None, None, "b"), (5, "", "de", "b"),
        (6, " \n\t", "de", None), (7, "kurz", "de", "b"), (None, PROSE + " end", "en", "c"),
        (None, None, None, None), (8, PROSE * 60, "en", "c"), (9, "日本語 😀 ▁x", "xx", "c"),
        (10, "a" * 3000, "en", "c"),
    ]
