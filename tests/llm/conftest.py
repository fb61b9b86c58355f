import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs([(doc_id, text)], source=..) with all columns of documents and clashing extra ones."""

    def make(rows, sources=None):
        full = [(k, t, "en", sources[i] if sources else "s", len(t) if t is not None else None, 7, "x") for i, (k, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOC + ", size long, tid string")

    return make
