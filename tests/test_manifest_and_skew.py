"""Manifests against scans, stale ones; hot buckets in blocks; many query blocks; what is persisted; partition files."""

import random

import pytest
from pyspark.sql import functions as F

from lshthemes.functions import TokenHashEncoder
from lshthemes.operators import (
    build_index,
    candidates,
    dense_buckets,
    density_search,
    index_stats,
    multi_probe_stats,
    search_exact,
    search_strategy,
)
from lshthemes.operators.maps import density_of_tiles, map_density, map_points, map_tiles, probe_classes, sketch_error
from lshthemes.operators.search import bucket_join, check_settings
from lshthemes.plans.models import LoadedModels, index_model
from lshthemes.plans.search import search_text
from lshthemes.registry import tables
from lshthemes.sources import CorpusShape, DatasetCatalog, merge_indexes, read_index, write_index
from lshthemes.sources.indexes import write_partitions
from lshthemes.sources.manifest import read_manifest, write_manifest
from lshthemes.streaming.index_stream import compact_bucket_counts, read_bucket_counts, stream_bucket_counts, write_bucket_counts
from tests.conftest import SF01


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "index")
    index = build_index(tables.vectors(spark, SF01), dim=64, carry=("embedding",), file_path="given")
    write_index(index, path, manifest=True)
    return path


def test_manifest_says_what_a_scan_says(spark, stored, vectors):
    index, manifest = read_index(spark, stored), read_manifest(spark, stored)
    asked = vectors.limit(40).withColumnRenamed("row_id", "query_id")
    for told in (dense_buckets, index_stats, lambda i: search_strategy(asked, i, dim=64), lambda i: multi_probe_stats(asked, i, dim=64)):
        assert rows_of(told(manifest)) == rows_of(told(index))
    found = density_search(asked, index, k=3, dim=64, payload=(), manifest=manifest)
    assert rows_of(found) == rows_of(density_search(asked, index, k=3, dim=64, payload=()))


def test_no_row_group_of_the_index_is_read(spark, stored, vectors):
    manifest = read_manifest(spark, stored)
    asked = vectors.limit(5).withColumnRenamed("row_id", "query_id")
    for df in (manifest, dense_buckets(manifest), search_strategy(asked, manifest, dim=64)):
        own = [f for f in df.inputFiles() if stored in f]
        assert own and all("/_manifest/" in f for f in own)
    check_settings(manifest, 12, 64)
    with pytest.raises(ValueError, match="seed"):
        check_settings(manifest, 8, 64, seed=5)
    with pytest.raises(ValueError, match="asked for"):
        check_settings(manifest, 20, 64)


def test_stale_and_missing_manifests_raise(spark, stored, tmp_path, vectors):
    more = build_index(vectors.limit(10), dim=64, carry=("embedding",), file_path="more")
    write_index(more, stored, mode="append")
    with pytest.raises(ValueError, match="changed"):
        read_manifest(spark, stored)
    write_manifest(spark, stored)
    assert read_manifest(spark, stored).agg(F.sum("entries")).first()[0] == read_index(spark, stored).count()
    write_index(more, str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="no manifest"):
        read_manifest(spark, str(tmp_path / "bare"))


def test_manifests_add_up(spark, stored, tmp_path, vectors):
    path = str(tmp_path / "other")
    write_index(build_index(vectors.limit(50), dim=64, file_path="other"), path, manifest=True)
    both = merge_indexes(read_manifest(spark, stored), read_manifest(spark, path))
    scanned = merge_indexes(read_index(spark, stored).drop("embedding"), read_index(spark, path))
    assert rows_of(dense_buckets(both)) == rows_of(dense_buckets(scanned))
    write_index(build_index(vectors.limit(5), dim=64, seed=9), str(tmp_path / "seed"), manifest=True)
    with pytest.raises(ValueError, match="differ"):
        merge_indexes(both, read_manifest(spark, str(tmp_path / "seed")))


def test_manifest_of_an_empty_index(spark, tmp_path, vectors):
    path = str(tmp_path / "empty")
    write_index(build_index(vectors.limit(0), dim=64), path, manifest=True)
    assert read_manifest(spark, path).count() == 0
    assert index_stats(read_manifest(spark, path)).first()["total_entries"] == 0


def test_hot_buckets_are_cut_and_only_their_queries_copied(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).cast("bigint").alias("bucket_id"), F.col("id").alias("row_id"))
    asked = spark.range(60).select(F.col("id").alias("query_id"), (F.col("id") % 20).alias("bucket_id"))
    want = rows_of(rows.join(asked, "bucket_id").select("bucket_id", "row_id", "query_id"))
    for hot_rows in (10, 500, 100_000):
        got = bucket_join(asked, rows, hot_rows=hot_rows)
        assert rows_of(got.select("bucket_id", "row_id", "query_id")) == want
    sizes = rows.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("size"))
    from lshthemes.operators.skew import every_block, hot_keys, with_blocks

    hot = hot_keys(sizes, ["bucket_id"], 500)
    assert rows_of(hot) == [(7, 7)]  # 3020 rows in blocks of 500
    copies = with_blocks(asked, hot, ["bucket_id"]).withColumn("block", every_block())
    assert copies.count() == 60 + 3 * 6  # three queries ask the hot bucket


def test_candidates_and_probe_classes_with_hot_buckets(spark, index, vectors, monkeypatch):
    asked = vectors.limit(30).withColumnRenamed("row_id", "query_id")
    points = map_points(vectors.withColumn("display_text", F.lit("")), index, dim=64)
    plain = rows_of(candidates(asked, index, dim=64)), rows_of(probe_classes(points, asked, dim=64))
    monkeypatch.setattr(bucket_join, "__defaults__", (None, 1))
    assert (rows_of(candidates(asked, index, dim=64)), rows_of(probe_classes(points, asked, dim=64))) == plain


@pytest.mark.parametrize("query_bytes", [3_000, 20_000])
def test_many_blocks_are_one_job_with_the_same_result(spark, vectors, query_bytes, monkeypatch):
    from lshthemes.operators import ranking

    monkeypatch.setattr(ranking, "CHUNK_BYTES", 30_000)  # several chunks of rows in a task
    rows = vectors.repartition(3)
    asked = vectors.limit(60).withColumnRenamed("row_id", "query_id")
    one = search_exact(asked, rows, k=4, dim=64, payload=())
    many = search_exact(asked, rows, k=4, dim=64, payload=(), query_bytes=query_bytes)
    assert rows_of(many) == rows_of(one)


def test_many_blocks_by_bucket_and_with_text_ids(spark, stored, vectors):
    index = read_index(spark, stored)
    asked = vectors.limit(50).select(F.concat(F.lit("q"), "row_id").alias("query_id"), "embedding")
    one = density_search(asked, index, k=3, dim=64, payload=())
    many = density_search(asked, index, k=3, dim=64, payload=(), query_bytes=4_000)
    assert rows_of(many) == rows_of(one)


class CountingEncoder(TokenHashEncoder):
    """Writes a line for every text it encodes."""

    def __init__(self, dim, path):
        super().__init__(dim)
        self.path = path

    def encode(self, texts):
        with open(self.path, "a") as log:
            log.write("".join("x\n" for _ in texts))
        return super().encode(texts)


def test_one_encode_for_a_search_and_its_report(spark, stored, tmp_path):
    texts = spark.createDataFrame([(k, f"text number {k} of many") for k in range(20)], "query_id bigint, text string")
    counts = {}
    for persist in (False, True):
        log = tmp_path / f"calls-{persist}"
        with search_text(texts, CountingEncoder(64, str(log)), read_index(spark, stored).withColumn("item_id", F.lit("i")).withColumn("title", F.lit("t")), persist=persist) as report:
            results, strategy = rows_of(report.results), rows_of(report.strategy)
            kept = report.held
        counts[persist] = len(log.read_text().splitlines())
        assert results and len(strategy) == 20
    assert counts[True] == 20 < counts[False]
    assert not kept.is_cached  # released on leaving


def test_models_are_loaded_once_and_released(spark, tmp_path):
    catalog = DatasetCatalog({"docs": str(tmp_path / "catalog")})
    corpus = tables.encoded_documents(spark, SF01).limit(30)
    corpus.write.parquet(catalog.corpus_path("docs", "words"))
    shape = CorpusShape(item_id="item_id", title="title", body="body", row_id="row_id")
    index_model(spark, catalog, "docs", "words", 64, shape=shape, manifest=True)
    with LoadedModels(spark, catalog, shape) as models:
        first = models.get("docs", "words")
        assert models.get("docs", "words") is first and first.index.is_cached and first.corpus.is_cached
        n = first.index.count()
    assert not first.index.is_cached and n == 30
    from lshthemes.plans.models import load_model

    told = load_model(spark, catalog, "docs", "words", shape, with_manifest=True)
    assert rows_of(told.stats) == rows_of(first.stats) and rows_of(told.dense) == rows_of(first.dense)


def test_partition_files(spark, tmp_path, vectors):
    path = str(tmp_path / "parts")
    index = build_index(vectors, dim=64, file_path="given")
    write_partitions(index, path, 5)
    write_partitions(index, path, 5)  # written again, nothing doubles
    index.limit(9).write.mode("append").parquet(path)
    assert rows_of(read_index(spark, path, layout="partitioned")) == rows_of(index)
    where = read_index(spark, path, layout="partitioned").select("bucket_id", F.input_file_name().alias("file")).distinct()
    assert where.groupBy("bucket_id").count().where("count > 1").isEmpty()  # whole buckets


def test_tiles_add_up_within_the_error(spark):
    pick = random.Random(4)
    points = spark.createDataFrame(
        [(pick.gauss(0, 3), pick.gauss(0, 3), pick.gauss(0, 3), f"0x{(b := int(abs(pick.gauss(0, 900))))}", 1 + b % 40) for _ in range(20_000)],
        "x double, y double, z double, bucket string, bucket_size bigint",
    )
    exact = map_density(points).first().asDict()
    whole = map_density(points, approx=True).first().asDict()
    halves = [map_tiles(points.where(c)) for c in ("x < 0", "x >= 0")]
    parted = density_of_tiles(halves[0].unionByName(halves[1])).first().asDict()
    n = exact.pop("unique_buckets")
    for told in (whole, parted):
        assert abs(told.pop("unique_buckets") - n) <= 3 * sketch_error() * n
        assert told == pytest.approx(exact)
    nothing = map_density(points.limit(0), approx=True).first()
    assert nothing["unique_buckets"] == 0 and nothing["num_dense"] == 0


def test_stream_writes_changed_buckets_only(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "bucket_id bigint, row_id bigint"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        write_bucket_counts(stream_bucket_counts(stream), path, state).awaitTermination()

    run([(1, 1), (1, 2), (2, 3)])
    run([(2, 4)])
    assert rows_of(read_bucket_counts(spark, path)) == [(1, 2), (2, 2)]
    by_batch = {r["batch"]: r["n"] for r in spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by_batch == {0: 2, 1: 1}  # the second batch wrote the one bucket it changed
    stream = spark.readStream.schema(schema).parquet(source)
    write_bucket_counts(stream_bucket_counts(stream), path, state).awaitTermination()  # nothing new, nothing twice
    assert rows_of(read_bucket_counts(spark, path)) == [(1, 2), (2, 2)]
    compact_bucket_counts(spark, path, str(tmp_path / "compacted"))
    assert rows_of(read_bucket_counts(spark, str(tmp_path / "compacted"))) == [(1, 2), (2, 2)]

