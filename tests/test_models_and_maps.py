import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lshthemes.operators import (
    ModelIndex,
    build_index,
    build_metadata,
    chosen_model,
    compare_models,
    corpus_profile,
    map_density,
    map_points,
    model_info,
    model_options,
    principal_axes,
    probe_classes,
)
from lshthemes.plans import index_model, load_model
from lshthemes.registry import tables
from lshthemes.sources import (
    DatasetCatalog,
    read_map_points,
    read_metadata,
    write_metadata,
)
from lshthemes.streaming import append_index, stream_bucket_counts, stream_index
from tests.conftest import SF001, SF01


@pytest.fixture
def metadata(vectors):
    models = []
    for dim, bits in ((16, 8), (32, 8), (48, 8), (64, 10)):
        cut = vectors.withColumn("embedding", F.slice("embedding", 1, dim))
        models.append(ModelIndex(f"m{dim}", f"First {dim} - of 64", build_index(cut, bits=bits, dim=dim)))
    return build_metadata(models, capacity=256)


def test_golden_metadata(metadata):
    rows = {r["dimension"]: r for r in metadata.collect()}
    got = {d: (r["lsh_bits"], r["num_buckets"], round(r["load_factor"], 4), r["dense_buckets"]) for d, r in rows.items()}
    assert got == {
        16: (8, 167, 0.6523, 34),
        32: (8, 196, 0.7656, 23),
        48: (8, 194, 0.7578, 25),
        64: (10, 363, 1.4180, 1),
    }


def test_load_is_over_the_buckets_of_the_hash_by_default(vectors):
    wide = build_metadata([ModelIndex("m", "d", build_index(vectors, bits=10, dim=64))]).first()
    assert wide["load_factor"] == pytest.approx(363 / 1024)


def test_metadata_files_and_views(spark, metadata, tmp_path):
    path = str(tmp_path / "models_metadata.parquet")
    with pytest.raises(FileNotFoundError, match="no model metadata"):
        read_metadata(spark, path)
    write_metadata(metadata, path)
    stored = read_metadata(spark, path)
    assert stored.count() == 4
    assert compare_models(stored).columns == [
        "model_name", "dimension", "lsh_bits", "num_buckets", "load_factor", "dense_buckets",
    ]
    assert model_info(stored, "m32").first()["num_buckets"] == 196
    options = model_options(stored).select("model_name", "option", chosen_model("option").alias("back")).collect()
    assert all(r["back"] == r["model_name"] and r["option"].startswith(r["back"] + ": First") for r in options)
    assert all("-" not in r["option"] for r in options)


def test_corpus_profile(vectors, documents):
    got = {r[0]: r[1] for r in corpus_profile({"v": vectors, "d": documents}).collect()}
    assert got == {"v": 500, "d": 1000}


def test_catalog_and_model_files(spark, tmp_path):
    catalog = DatasetCatalog({"tweets": str(tmp_path)})
    with pytest.raises(ValueError, match="Unknown dataset: papers"):
        catalog.folder("papers")
    rows = [(str(i), f"text {i}", [float(i % 3), 1.0]) for i in range(12)]
    source = spark.createDataFrame(rows, "tweet_id string, text string, embedding array<float>")
    source.coalesce(1).write.parquet(catalog.corpus_path("tweets", "tiny"))
    stored = index_model(spark, catalog, "tweets", "tiny", dim=2)
    assert stored.count() == 12 and stored.select("row_id", "file_path").distinct().count() == 12
    model = load_model(spark, catalog, "tweets", "tiny", min_count=1)
    assert model.corpus.count() == 12
    assert model.stats.first()["total_entries"] == 12
    assert model.dense.agg(F.sum("count")).first()[0] == 12
    assert model.index.join(model.corpus, ["file_path", "row_id"]).count() == 12
    assert read_map_points(spark, catalog.map_path("tweets", "tiny")).count() == 0


def test_map_points_and_density(vectors, index, documents, spark, tmp_path):
    corpus = vectors.join(documents.select("row_id", "display_text"), "row_id")
    points = map_points(corpus, index, dim=64)
    assert points.count() == 500 and points.where("bucket <> concat('0x', lower(hex(bucket_int)))").count() == 0
    density = map_density(points).first()
    sizes = index.groupBy("bucket_id").count()
    weighted = sizes.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    assert density["avg_size"] == pytest.approx(weighted)
    assert (density["max_size"], density["unique_buckets"], density["num_dense"]) == (8, 210, 0)
    path = str(tmp_path / "map")
    points.write.parquet(path)
    assert read_map_points(spark, path).count() == 500
    assert tuple(map_density(points.limit(0)).first()) == (None, None, None, 0, None, 0)


def test_probe_classes_name_points_once(spark, vectors, index, documents):
    points = map_points(vectors.join(documents.select("row_id", "display_text"), "row_id"), index, dim=64)
    queries = tables.text_queries(spark, SF01)
    near = probe_classes(points, queries, dim=64)
    assert near.count() == near.select("query_id", "row_id").distinct().count()
    assert {r[0] for r in near.select("probe_class").distinct().collect()} == {"red", "orange"}
    every = probe_classes(points, queries, radius=8, dim=64)
    assert every.count() == 40 * 500 and near.exceptAll(every).count() == 0


def test_streamed_index_is_the_batch_index(spark, index, tmp_path):
    schema = spark.read.parquet(f"{SF01}/embeddings.parquet").schema
    source = str(tmp_path / "in")
    spark.read.parquet(f"{SF01}/embeddings.parquet").repartition(3).write.parquet(source)

    def stream():
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return stream_index(files.withColumnRenamed("vec_id", "row_id"), 64)

    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        append_index(stream(), path, state).awaitTermination()
    stored = spark.read.parquet(path)
    assert stored.count() == 500
    assert stored.drop("file_path").exceptAll(index.drop("file_path")).count() == 0

    query = (
        stream_bucket_counts(stream())
        .writeStream.format("memory")
        .queryName("bucket_counts")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    want = {r[0]: r[1] for r in index.groupBy("bucket_id").count().collect()}
    assert {r[0]: r[1] for r in spark.table("bucket_counts").collect()} == want


def test_principal_axes(vectors, index, documents):
    axes = principal_axes(vectors, 64)
    matrix = np.array([r["embedding"] for r in vectors.select("embedding").collect()], dtype=float)
    values = np.linalg.eigvalsh(np.cov(matrix.T))[::-1][:3]
    spread = np.var((matrix - matrix.mean(axis=0)) @ axes.T, axis=0, ddof=1)
    assert np.allclose(spread, values)
    corpus = vectors.join(documents.select("row_id", "display_text"), "row_id")
    points = map_points(corpus, index, dim=64, axes=axes).agg(F.var_samp("x")).first()[0]
    assert points == pytest.approx(values[0])


def test_tasks_need_no_package(tmp_path):
    """A driver elsewhere, with the package on its own path only."""
    repo = Path(__file__).parents[1]
    script = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("density_search", "map_points", "encode_documents"):
    print(name, entry.queries()[name](spark, {SF001!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "map_points 500" in done.stdout
