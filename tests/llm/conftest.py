import pytest

EXTRA = "doc_id bigint, text string, key string, n bigint, hash string, row string, `a.b` string"


@pytest.fixture(scope="session")
def docs(spark):
    """Build documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, "k", 1, "h", "r", "d") for i, t in rows], EXTRA)
    return make
