"""Hashing needs no state, so a stream of corpus rows can extend an index as it arrives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lshthemes.functions.hashing import BASE_BITS, SEED
from lshthemes.operators.index import build_index, bucket_sizes


def stream_index(
    stream: DataFrame, dim: int, bits: int = BASE_BITS, seed: int = SEED, carry: Sequence[str] = ()
) -> DataFrame:
    """Index rows of a streaming corpus; ids agree with those of a batch build."""
    return build_index(stream, bits, seed, dim, carry)


def append_index(index_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the index rows that are there now to a parquet index, then stop.

    The file sink and the checkpoint make a repeated run add nothing twice.
    """
    return (
        index_stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_bucket_counts(index_stream: DataFrame) -> DataFrame:
    """Running size of every bucket.

    The state has a row per bucket, so the width of the hash bounds it and it needs no watermark. Write it
    with output mode ``update`` or ``complete``.
    """
    return bucket_sizes(index_stream).withColumnRenamed("size", "count")


def write_bucket_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the sizes that a batch changed to a folder of that batch, then stop. A batch that runs again replaces its own
    folder, so nothing counts twice. ``compact_bucket_counts`` makes one folder of many."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        counts.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _last_written(counts: DataFrame) -> DataFrame:
    return counts.groupBy("bucket_id").agg(F.max(F.struct("batch", "count")).alias("last"))


def read_bucket_counts(spark: SparkSession, path: str) -> DataFrame:
    """The size of every bucket, as the last batch that changed it wrote it."""
    return _last_written(spark.read.parquet(path)).select("bucket_id", "last.count")


def compact_bucket_counts(spark: SparkSession, path: str, compacted: str) -> None:
    """The sizes now, at another path, under the batch that wrote them last; batches to come may be added there."""
    last = _last_written(spark.read.parquet(path)).select("bucket_id", "last.count", "last.batch")
    last.write.partitionBy("batch").parquet(compacted)
