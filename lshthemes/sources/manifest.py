"""What an index says about itself without being read: its settings, and the entries of every hash per file.

The manifest lies in ``_manifest`` below the index, where readers of the index pass over it. Its rows have the columns of an
index but ``entries`` in place of single rows, so whatever only counts (densities, strategies, probe statistics, settings)
takes it in place of the index. Manifests of several indexes add up by a union. Reading one compares the files it was made
from with those that are there now, by name and length, and raises where they differ.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_manifest"
_COLUMNS = ("bucket_id", "hash", "file_path", "seed", "dim", "bits")


def _name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths of the data files of an index, from a listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(_name("path").alias("file"), F.col("length").cast("bigint").alias("length"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """Count the entries of a stored index, by settings, file and hash. Only those columns are read."""
    index = spark.read.parquet(path)
    missing = [c for c in ("hash", "seed", "dim", "bits") if c not in index.columns]
    if missing:
        raise ValueError(f"the index has no {', '.join(missing)}, so it can have no manifest")
    by = [c for c in _COLUMNS if c in index.columns]
    counts = index.groupBy(_name("_metadata.file_path").alias("file"), *by).agg(F.count("row_id").alias("entries"))
    counts.write.mode("overwrite").parquet(f"{path}/{FOLDER}/entries")
    _files(spark, path).write.mode("overwrite").parquet(f"{path}/{FOLDER}/files")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an index. Raises without one, or where the index has changed since it was written."""
    try:
        files = spark.read.parquet(f"{path}/{FOLDER}/files")
        counts = spark.read.parquet(f"{path}/{FOLDER}/entries")
    except AnalysisException as error:
        raise ValueError(f"the index at {path} has no manifest; write_manifest makes one") from error
    now = _files(spark, path)
    changed = files.exceptAll(now).unionAll(now.exceptAll(files))
    if not changed.isEmpty():
        raise ValueError(f"the index at {path} has changed since its manifest was written")
    return counts.drop("file")
