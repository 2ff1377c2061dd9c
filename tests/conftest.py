import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lshthemes.operators import build_index
from lshthemes.registry import tables
from lshthemes.sources.scratch import name_local_scratch

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    name_local_scratch(session)
    yield session
    session.stop()


@pytest.fixture
def vectors(spark):
    return tables.vectors(spark, SF01)


@pytest.fixture
def index(spark):
    return tables.vector_index(spark, SF01)


@pytest.fixture
def documents(spark):
    return tables.documents(spark, SF01)


@pytest.fixture
def make_vectors(spark):
    """Rows ``(row_id, embedding)`` with an item id and a title each."""

    def make(rows, id_name="row_id"):
        df = spark.createDataFrame(
            [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows],
            f"{id_name} bigint, embedding array<float>",
        )
        return df.withColumns(
            {"item_id": F.concat(F.lit("i"), id_name), "title": F.concat(F.lit("t"), id_name)}
        )

    return make


@pytest.fixture
def searchable(make_vectors):
    def make(rows, dim, **kw):
        return build_index(make_vectors(rows), dim=dim, carry=("embedding", "item_id", "title"), **kw)

    return make
