"""Points of a 3-D map of the space, coloured by bucket."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.hashing import (
    BASE_BITS,
    HASH_BITS,
    SEED,
    bucket_hex,
    hash_vectors,
    hyperplanes,
    keyed_by_bucket,
    low_bits,
    probe_masks,
)
from lshthemes.functions.vectors import infer_dim, project
from lshthemes.operators.index import bucket_sizes
from lshthemes.operators.search import bucket_join, check_settings, hash_queries, index_at

# Sketches of distinct buckets have two to the power of this many cells.
LG_K = 12


def principal_axes(corpus: DataFrame, dim: int) -> np.ndarray:
    """The three directions in which the vectors vary most, as axes for ``map_points``.

    Tasks add up one ``dim`` by ``dim`` matrix each; no vector reaches the driver. Of the two signs of an axis
    the one with a positive largest component is taken.
    """
    whole = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    rows = corpus.where(usable).select(array_to_vector(whole).alias("features"))
    fitted = PCA(k=3, inputCol="features", outputCol="at").fit(rows)
    axes = fitted.pc.toArray().T
    largest = np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1)
    return axes * np.sign(largest)


def map_points(
    corpus: DataFrame,
    index: DataFrame,
    bits: int = BASE_BITS,
    seed: int = SEED,
    dim: int | None = None,
    axes: np.ndarray | None = None,
    index_bits: int | None = None,
) -> DataFrame:
    """A point for every corpus row: a projection of its vector, its bucket and the bucket's size.

    The bucket follows from the vector in the same pass, so the index is only needed for sizes, one row per
    bucket. The three axes are random, the planes after those of the hash, unless ``axes`` are given, such as
    ``principal_axes``.
    """
    dim = dim or infer_dim(corpus)
    check_settings(index, bits, dim, seed, index_bits)
    n_planes = max(bits, HASH_BITS)
    planes = hyperplanes(dim, n_planes + 3, seed)
    sizes = bucket_sizes(index_at(index, bits)).toDF("bucket_int", "bucket_size")
    placed = (
        hash_vectors(corpus, planes[:n_planes])
        .where(F.col("hash").isNotNull())
        .select(
            *[c for c in ("file_path", "row_id") if c in corpus.columns],
            project("embedding", planes[n_planes:] if axes is None else axes).alias("at"),
            F.col("display_text").alias("text"),
            low_bits("hash", bits).alias("bucket_int"),
        )
    )
    return placed.join(keyed_by_bucket(sizes, bits), "bucket_int", "left").select(
        *[c for c in ("file_path", "row_id") if c in corpus.columns],
        "at.x",
        "at.y",
        "at.z",
        "text",
        bucket_hex("bucket_int").alias("bucket"),
        "bucket_int",
        F.coalesce("bucket_size", F.lit(0).cast("bigint")).alias("bucket_size"),
    )


def map_density(points: DataFrame, threshold: int = 10, approx: bool = False, lg_k: int = LG_K) -> DataFrame:
    """Density as the points see it: large buckets weigh more.

    Points are summed up per bucket and size first, so the distinct count sees one row per bucket. With ``approx`` that
    count comes from sketches (``map_tiles``) and no row per bucket is shuffled.
    """
    if approx:
        return density_of_tiles(map_tiles(points, threshold=threshold, lg_k=lg_k))
    per_bucket = points.groupBy("bucket", "bucket_size").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    dense = F.sum(F.when(F.col("bucket_size") >= threshold, F.col("n")).otherwise(zero))
    total = F.sum("n")
    return per_bucket.agg(
        F.max("bucket_size").alias("max_size"),
        F.min("bucket_size").alias("min_size"),
        F.try_divide(F.sum(F.col("bucket_size") * F.col("n")), total).alias("avg_size"),
        F.coalesce(dense, zero).alias("num_dense"),
        F.try_divide(100 * dense, total).alias("pct_dense"),
        F.countDistinct("bucket").alias("unique_buckets"),
    )


def map_tiles(points: DataFrame, width: float = 1.0, threshold: int = 10, lg_k: int = LG_K) -> DataFrame:
    """The density of every cube of the map, in a form that adds up: sums, extremes, and a sketch of the buckets.

    Tiles of several maps, or of points that came later, are united as rows; ``density_of_tiles`` reads them together.
    """
    tile = [F.floor(F.col(c) / width).cast("bigint").alias(f"tile_{c}") for c in "xyz"]
    return points.groupBy(*tile).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("bucket_size") >= threshold).alias("dense"),
        F.sum("bucket_size").alias("sizes"),
        F.max("bucket_size").alias("max_size"),
        F.min("bucket_size").alias("min_size"),
        F.hll_sketch_agg("bucket", F.lit(lg_k)).alias("buckets"),
    )


def density_of_tiles(tiles: DataFrame) -> DataFrame:
    """``map_density`` from tiles. All is exact but the number of buckets: its relative standard error is
    ``sketch_error(lg_k)``."""
    zero = F.lit(0).cast("bigint")
    return tiles.agg(
        F.max("max_size").alias("max_size"),
        F.min("min_size").alias("min_size"),
        F.try_divide(F.sum("sizes"), F.sum("n")).alias("avg_size"),
        F.coalesce(F.sum("dense"), zero).alias("num_dense"),
        F.try_divide(100 * F.sum("dense"), F.sum("n")).alias("pct_dense"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("buckets")), zero).alias("unique_buckets"),
    )


def sketch_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a sketch of ``2 ** lg_k`` cells that was united from others."""
    return 1.04 / math.sqrt(2**lg_k)


def probe_classes(
    points: DataFrame,
    queries: DataFrame,
    bits: int = BASE_BITS,
    radius: int = 2,
    dim: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Colour of the points for each query: ``red`` in its bucket, ``orange`` in a probed one.

    All other points are ``lightgray`` and have no row. It is an equi-join on the bucket.
    """
    flips = F.array(*[F.lit(m).cast("bigint") for m in probe_masks(bits, radius)])
    colour = F.when(F.col("mask") == 0, "red").otherwise("orange")
    classes = (
        hash_queries(queries, dim, bits, seed=seed)
        .select("query_id", F.col("bucket_id").alias("own"), F.explode(flips).alias("mask"))
        .select(
            "query_id",
            F.col("own").bitwiseXOR(F.col("mask")).alias("bucket_id"),
            colour.alias("probe_class"),
        )
    )
    place = [c for c in ("file_path", "row_id") if c in points.columns]
    rows = points.select(F.col("bucket_int").alias("bucket_id"), *place)
    return bucket_join(classes, rows).select("query_id", *place, "probe_class")
