import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lshthemes.operators import (
    bucket_items,
    bucket_size_histogram,
    build_index,
    dangling_entries,
    dense_buckets,
    density_stats,
    index_health,
    index_stats,
    inverted_lists,
)
from lshthemes.sources import CorpusShape, load_corpus, merge_indexes, read_index, write_index
from lshthemes.sources.scratch import scratch_path
from tests.conftest import SF001

GOLDEN = {
    "0.001": (202, 26, 0, 7, [(28, 7), (159, 7), (24, 6), (55, 6), (99, 6)]),
    "0.01": (210, 17, 0, 8, [(39, 8), (26, 7), (96, 6), (141, 6), (173, 6)]),
    "0.1": (256, 200, 74, 23, [(55, 23), (23, 21), (232, 20), (224, 18), (99, 17)]),
}


@pytest.mark.parametrize("sf", GOLDEN)
def test_golden_buckets(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    index = build_index(rows)
    n, five, ten, largest, top = GOLDEN[sf]
    assert [tuple(r) for r in dense_buckets(index, top_n=5).collect()] == top
    assert dense_buckets(index).count() == five
    stats = density_stats(index).first()
    assert (stats["num_buckets"], stats["dense_buckets"], stats["max_size"]) == (n, ten, largest)


def entries(spark, rows):
    return spark.createDataFrame(rows, "bucket_id bigint, file_path string, row_id bigint")


def test_empty_index(spark):
    empty = entries(spark, [])
    assert tuple(index_stats(empty).first()) == (0, 0, None, 0.0)
    assert tuple(density_stats(empty).first()) == (0, None, None, 0, 0)
    assert dense_buckets(empty).count() == bucket_size_histogram(empty).count() == 0


def test_null_ids(spark):
    index = entries(spark, [(1, "f", 0), (1, "f", None), (None, "f", 2)])
    assert tuple(index_stats(index).first())[:2] == (2, 2)
    sizes = {r["size"]: r["count"] for r in bucket_size_histogram(index).collect()}
    assert sizes == {1: 1}
    corpus = spark.createDataFrame([(0, [1.0])], "row_id bigint, embedding array<float>")
    assert tuple(index_health(index, corpus, 2).first()) == (1, 1, 1)


def test_bounds_are_inclusive(spark):
    index = entries(spark, [(1, "f", i) for i in range(5)] + [(2, "f", i) for i in range(10)] + [(3, "f", 1)])
    assert [tuple(r) for r in dense_buckets(index).collect()] == [(2, 10), (1, 5)]
    assert density_stats(index).first()["dense_buckets"] == 1


def test_load_factor_may_exceed_one(spark):
    index = entries(spark, [(i, "f", i) for i in range(300)])
    assert index_stats(index).first()["load_factor"] > 1
    assert index_stats(index, capacity=1024).first()["load_factor"] < 1


def test_ragged_vectors_are_left_out_and_counted(make_vectors):
    corpus = make_vectors([(0, [1, 2]), (1, [1]), (2, None)])
    index = build_index(corpus, dim=2)
    assert [r["row_id"] for r in index.collect()] == [0]
    assert index_health(index, corpus, 2).first()["bad_vectors"] == 2


def test_dim_is_the_width_of_all_vectors(spark, make_vectors):
    assert build_index(make_vectors([(0, None), (1, [1, 2]), (2, [1, 2])])).first()["dim"] == 2
    with pytest.raises(ValueError, match="dim must be given"):
        build_index(make_vectors([(0, None)]))
    # no prefix of the rows decides: 1,000 narrow vectors before 5,000 wide ones
    width = F.when(F.col("id") < 1000, 2).otherwise(3)
    ragged = spark.range(6000).select(
        F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), width), lambda x: x.cast("float")).alias("embedding")
    )
    with pytest.raises(ValueError, match="2 to 3 components"):
        build_index(ragged)
    assert build_index(ragged, dim=3).count() == 5000


def test_bits_fit_a_hash(make_vectors):
    corpus = make_vectors([(0, [1, 2])])
    assert build_index(corpus, bits=62, dim=2).count() == 1
    for bits in (0, 63):
        with pytest.raises(ValueError, match="do not fit"):
            build_index(corpus, bits=bits, dim=2)


def test_merge_looks_at_every_row(make_vectors):
    corpus = make_vectors([(i, [1, i]) for i in range(50)])
    one, other = build_index(corpus, dim=2), build_index(corpus, dim=2, seed=7)
    mixed = one.unionByName(other)
    with pytest.raises(ValueError, match="differ in seed"):
        merge_indexes(mixed, one)
    with pytest.raises(ValueError, match="indexes differ"):
        merge_indexes(one, other)
    assert merge_indexes(one, one.limit(0), one).count() == 100


def test_rows_of_several_files_need_a_corpus_that_names_them(make_vectors):
    corpus = make_vectors([(0, [1, 2])])
    merged = merge_indexes(build_index(corpus, dim=2, file_path="a"), build_index(corpus, dim=2, file_path="b"))
    with pytest.raises(ValueError, match="several files"):
        bucket_items(merged, corpus)
    named = corpus.withColumn("file_path", F.lit("a"))
    assert bucket_items(merged, named).count() == 1


def test_files_of_like_names_have_rows_of_their_own(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(8)], "doc_id int, text string, part int").coalesce(1).write.partitionBy("part").parquet(path)
    corpus = load_corpus(spark, path, CorpusShape(item_id="doc_id", body="text"))
    assert corpus.select("file_path", "row_id").distinct().count() == 8


def test_scratch_asks_for_a_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())

    class Context:
        applicationId = "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")


def test_inverted_list_chunks_rebuild_the_bucket(index):
    lists = {}
    rows = sorted(inverted_lists(index, 50).collect(), key=lambda r: (r["bucket_id"], r["chunk"]))
    for r in rows:
        assert all(i // 50 == r["chunk"] for i in r["row_ids"])
        lists.setdefault(r["bucket_id"], []).extend(r["row_ids"])
    want = {}
    for r in index.orderBy("row_id").collect():
        want.setdefault(r["bucket_id"], []).append(r["row_id"])
    assert lists == want


def test_dangling_entries(spark, index):
    few = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("row_id"))
    assert dangling_entries(index, few).count() == 300


def test_merged_parts_equal_one_build(vectors, index):
    parts = [
        build_index(vectors.where(F.col("row_id") % 2 == i), dim=64, file_path=f"part{i}") for i in (0, 1)
    ]
    merged = merge_indexes(*parts)
    assert merged.drop("file_path").exceptAll(index.drop("file_path")).count() == 0
    assert merged.count() == index.count()
    by_file = dangling_entries(merged, vectors.withColumn("file_path", F.lit("part0")))
    assert by_file.count() == 250


def test_merging_checks_settings(vectors, index):
    with pytest.raises(ValueError, match="differ in seed, dim or bits"):
        merge_indexes(index, build_index(vectors, bits=10, dim=64))
    with pytest.raises(ValueError, match="needs its seed"):
        merge_indexes(index, index.drop("seed"))


def test_stored_index_is_clustered_and_pruned(spark, index, tmp_path):
    path = str(tmp_path / "index")
    write_index(index, path)
    stored = read_index(spark, path)
    assert stored.exceptAll(index).count() == 0 and stored.count() == index.count()
    plan = stored.where("bucket_id = 39")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(bucket_id,39)" in plan
    runs = stored.withColumn("file", F.input_file_name()).collect()
    for file in {r["file"] for r in runs}:
        ids = [r["bucket_id"] for r in runs if r["file"] == file]
        assert ids == sorted(ids)


def test_partitioned_layout_reads_only_partition_files(spark, tmp_path):
    table = pa.table({"bucket_id": pa.array([1, 2], pa.uint64()), "file_path": ["a", "a"], "row_id": pa.array([0, 1], pa.uint32())})
    for name in ("partition_0.parquet", "partition_1.parquet", "other.parquet"):
        pq.write_table(table, tmp_path / name)
    assert read_index(spark, str(tmp_path)).count() == 6
    index = read_index(spark, str(tmp_path), layout="partitioned")
    assert dict(index.dtypes) == {"bucket_id": "bigint", "file_path": "string", "row_id": "bigint"}
    assert [tuple(r) for r in dense_buckets(index, min_count=1).collect()] == [(1, 2), (2, 2)]
    assert read_index(spark, str(tmp_path / "partition_0.parquet")).count() == 2


