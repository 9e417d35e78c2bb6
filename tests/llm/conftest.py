import pytest


@pytest.fixture
def docs(spark):
    """docs([...]): documents with the given texts, ids from 0."""

    def make(texts, ids=None, **more):
        rows = [(i, t, more.get("lang"), "s", len(t or "")) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
