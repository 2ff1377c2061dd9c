"""The bucket index as parquet."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lshthemes.sources.files import locate
from lshthemes.sources.manifest import write_manifest

SETTINGS = ("seed", "dim", "bits")


def write_index(index: DataFrame, path: str, mode: str = "errorifexists", manifest: bool = False) -> None:
    """Write the index clustered by bucket, so statistics skip the files and row groups of other buckets; with ``manifest``
    also what ``read_manifest`` reads, for which the hashes are read once more.

    The index is computed once: rebalancing needs no sample pass. It spreads a hot bucket over as many
    files as its size asks for and packs small ones together (with adaptive execution, Spark's default).
    """
    order = [c for c in ("bucket_id", "file_path", "row_id") if c in index.columns]
    (
        index.hint("rebalance", "bucket_id")
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .parquet(path)
    )
    if manifest:
        write_manifest(index.sparkSession, path)


def read_index(spark: SparkSession, path: str, layout: str = "spark") -> DataFrame:
    """Read an index: a file or folder, or with ``layout="partitioned"`` the ``partition_*`` files."""
    if layout not in ("spark", "partitioned"):
        raise ValueError(f"unknown index layout {layout!r}")
    reader = spark.read
    if layout == "partitioned":
        reader = reader.option("pathGlobFilter", "partition_*.parquet")
    index = reader.parquet(path)
    # Foreign files may hold unsigned ids, which arrive as decimals.
    ids = {c: F.col(c).cast("bigint") for c in ("bucket_id", "row_id")}
    return index.withColumns({c: v for c, v in ids.items() if dict(index.dtypes)[c] != "bigint"})


def write_partitions(index: DataFrame, path: str, parts: int) -> None:
    """Write the index as the files ``partition_00000.parquet`` and on, each with whole buckets, for ``layout="partitioned"``.
    A task that runs again replaces its file."""
    arrow = to_arrow_schema(index.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where, at = locate(f"{path}/partition_{part:05d}.parquet")
        where.create_dir(at.rpartition("/")[0], recursive=True)
        rows = 0
        with where.open_output_stream(at) as sink, pq.ParquetWriter(sink, arrow) as file:
            for batch in batches:
                file.write_table(pa.Table.from_batches([batch]).cast(arrow))
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    dealt = index.repartition(parts, "bucket_id").sortWithinPartitions("bucket_id", "row_id")
    dealt.mapInArrow(write, "rows bigint").agg(F.sum("rows")).collect()


def settings_of(index: DataFrame) -> dict[str, int] | None:
    """Seed, width and bits of an index, None for one without rows. Raises where rows differ in them."""
    row = index.agg(*[f(c).alias(f"{n}_{c}") for c in SETTINGS for n, f in (("low", F.min), ("high", F.max))]).first()
    if row[f"low_{SETTINGS[0]}"] is None:
        return None
    mixed = [c for c in SETTINGS if row[f"low_{c}"] != row[f"high_{c}"]]
    if mixed:
        raise ValueError(f"rows of one index differ in {', '.join(mixed)}")
    return {c: row[f"low_{c}"] for c in SETTINGS}


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """Union of indexes built apart with the same seed, width and bits; anything else raises.

    All rows are looked at, through the lowest and highest value of each setting. ``file_path`` is kept: rows of
    different parts may share a ``row_id``.
    """
    if not all(set(SETTINGS) <= set(i.columns) for i in indexes):
        raise ValueError("every index needs its seed, dim and bits to be merged")
    seen = {tuple(s.values()) for s in map(settings_of, indexes) if s}
    if len(seen) > 1:
        raise ValueError(f"indexes differ in seed, dim or bits: {sorted(seen)}")
    return reduce(DataFrame.unionByName, indexes)


def compact_index(spark: SparkSession, path: str, compacted: str, manifest: bool = False) -> None:
    """Rewrites an index that a stream appended to, clustered by bucket, at another path."""
    write_index(read_index(spark, path), compacted, manifest=manifest)
