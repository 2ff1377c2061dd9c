import pytest

from tests.conftest import spark  # noqa: F401


@pytest.fixture
def docs(spark):  # noqa: F811
    """Documents with given texts, ids counting up, beside columns whose names operators use themselves."""

    def make(texts, first=0):
        rows = [(first + k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "1L AS n_chars", "7 AS id", "8 AS h", "9 AS salt", "true AS kept", "0 AS fp")

    return make
