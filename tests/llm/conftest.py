import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of ``documents`` with an extra column whose name clashes with results."""
    def make(rows):
        full = [(i, t, *(list(rest) + [None, None, None])[:2], None if t is None else len(t), "x")
                for i, t, *rest in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
