"""Results as short text, for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.hashing import bucket_hex


def fixed(value: Column | str, digits: int) -> Column:
    """A number with a fixed count of decimals, halves going to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(F.col(value) if isinstance(value, str) else value, digits))


def percent(share: Column | str, digits: int = 1) -> Column:
    share = F.col(share) if isinstance(share, str) else share
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def model_report(metadata: DataFrame) -> DataFrame:
    return metadata.select("model_name", percent("load_factor").alias("load"))


def search_report(strategy: DataFrame) -> DataFrame:
    """The outcome of ``search_strategy`` for each query."""
    refined = F.col("status") == "refined"
    cut = F.concat(F.lit("Reduced by "), fixed("reduction_pct", 0), F.lit("%"))
    return strategy.select(
        "query_id",
        bucket_hex("bucket_id").alias("bucket"),
        F.when(F.col("status") == "empty", "No documents")
        .when(refined, "Dense, refined")
        .otherwise("Sparse, direct")
        .alias("strategy"),
        F.when(refined, bucket_hex("level_1_hash")).alias("level_1"),
        F.when(refined, cut).alias("reduction"),
    )


def probe_report(stats: DataFrame) -> DataFrame:
    """The outcome of ``multi_probe_stats`` for each query."""
    found = F.col("total_candidates").cast("string")
    share = F.concat(F.lit(" ("), fixed("pct_candidates", 1), F.lit("% of dataset)"))
    return stats.select(
        "query_id",
        F.concat(found, share).alias("candidates"),
        F.concat(fixed("speedup", 1), F.lit("x")).alias("speedup"),
    )


def map_report(density: DataFrame) -> DataFrame:
    """The outcome of ``map_density``."""
    sizes = F.format_string("%d to %d documents (avg: %s)", "min_size", "max_size", fixed("avg_size", 1))
    return density.select(
        F.concat(F.col("unique_buckets").cast("string"), F.lit(" buckets")).alias("buckets"),
        sizes.alias("sizes"),
        F.concat(fixed("pct_dense", 1), F.lit("% of points in dense buckets")).alias("dense"),
    )
