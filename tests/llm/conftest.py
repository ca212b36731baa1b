import pytest

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, words string, size bigint, row string, cut string, key string"


@pytest.fixture
def documents(spark):
    """A maker of document tables with further columns whose names operators use inside."""
    def make(rows):
        full = []
        for r in rows:
            doc_id, text, *more = r
            lang, source = (*more, None, None)[:2]
            full.append((doc_id, text, lang, source, None if text is None else len(text), 0.5, 7, "w", 9, "r", "c", "k"))
        return spark.createDataFrame(full, WIDE)
    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
