"""Model metadata and map points."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = (
    "model_name string, description string, dimension bigint, lsh_bits bigint, "
    "num_buckets bigint, load_factor double, dense_buckets bigint"
)
MAP_POINTS = (
    "row_id bigint, x double, y double, z double, text string, bucket string, "
    "bucket_int bigint, bucket_size bigint"
)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _typed(spark: SparkSession, df: DataFrame, schema: str) -> DataFrame:
    fields = spark.createDataFrame([], schema).schema
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    try:
        return _typed(spark, spark.read.parquet(path), METADATA)
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no model metadata at {path}; write it first") from e
        raise


def write_metadata(metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per model, so one file."""
    metadata.coalesce(1).write.mode(mode).parquet(path)


def read_map_points(spark: SparkSession, path: str) -> DataFrame:
    """Map points are optional: a missing file reads as an empty table."""
    try:
        return _typed(spark, spark.read.parquet(path), MAP_POINTS)
    except AnalysisException as e:
        if _missing(e):
            return spark.createDataFrame([], MAP_POINTS)
        raise
