"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from lshthemes import registry
from tests.conftest import SF001


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF001}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(entry.queries()[name](spark, SF001).toPandas())
    want = rows_of(duck.execute(registry.oracle_sql()[name]).df())
    assert got == want


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [(r["bucket_id"], r["count"]) for r in rows][:3] == [(28, 7), (159, 7), (24, 6)]


@pytest.mark.parametrize("name", ["streamed_index", "stream_counts"])
def test_stream_reads_a_table_of_many_files(spark, tmp_path, name):
    spark.read.parquet(f"{SF001}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows_of(entry.queries()[name](spark, str(tmp_path)).toPandas())
    assert got == rows_of(entry.queries()[name](spark, SF001).toPandas())
