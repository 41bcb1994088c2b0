import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (or from rows), with columns whose names the operators use inside."""

    def make(texts, source=None):
        rows = [t if isinstance(t, tuple) else (k, t, source) for k, t in enumerate(texts)]
        schema = "doc_id long, text string, source string, lang string, n_chars long, size long, target string, cls string, key int, n_words string, bits int, copies int, label int"
        return spark.createDataFrame([(i, t, s, "en", None if t is None else len(t), 7, "x", "c", 1, "w", 0, 9, 3) for i, t, s in rows], schema)

    return make
