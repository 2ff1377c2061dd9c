"""From buckets to the items in them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lshthemes.functions.hashing import keyed_by_bucket
from lshthemes.operators.index import identity


def in_buckets(
    index: DataFrame, buckets: DataFrame | Iterable[int] | None, bits: int | None = None
) -> DataFrame:
    """Entries of the named buckets. A list of ids becomes a filter that reaches the parquet scan."""
    if buckets is None:
        return index
    if isinstance(buckets, DataFrame):
        wanted = buckets.select("bucket_id").distinct()
        return index.join(keyed_by_bucket(wanted, bits), "bucket_id", "left_semi")
    return index.where(F.col("bucket_id").isin(list(buckets)))


def bucket_items(
    index: DataFrame,
    corpus: DataFrame,
    buckets: DataFrame | Iterable[int] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Items of all named buckets with one join; entries without a corpus row drop out.

    The join runs on the row identity, which no bucket can skew. ``bits`` is the width of the bucket ids,
    which bounds ``buckets`` when that is a table.
    """
    keys = identity(index, corpus)
    entries = in_buckets(index, buckets, bits).select("bucket_id", *keys)
    return entries.join(corpus, keys).select(
        "bucket_id", "row_id", *[c for c in corpus.columns if c != "row_id"]
    )


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("file_path", "row_id") if c in df.columns]


def sample_items(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items of every bucket, numbered in ``pos``.

    The rank filter also runs before the shuffle, so each task sends at most ``n`` rows per bucket.
    """
    first = Window.partitionBy("bucket_id").orderBy(*_order(items))
    sampled = items.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= n)
    return sampled.withColumn("pos", F.col("pos").cast("bigint"))


def present_entries(
    index: DataFrame,
    corpus: DataFrame,
    buckets: DataFrame | Iterable[int] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Entries that have a corpus row. Only row ids are shuffled, no text."""
    keys = identity(index, corpus)
    entries = in_buckets(index, buckets, bits).select("bucket_id", *keys)
    return entries.join(corpus.select(*keys), keys, "left_semi")


def sample_bucket_items(
    index: DataFrame,
    corpus: DataFrame,
    buckets: DataFrame | Iterable[int] | None,
    n: int,
    bits: int | None = None,
) -> DataFrame:
    """``sample_items(bucket_items(...), n)`` without moving the text of whole buckets.

    Only row ids are shuffled to find which entries exist. The sample is taken from those, and the text is
    fetched for the sampled rows alone.
    """
    keys = identity(index, corpus)
    sample = sample_items(present_entries(index, corpus, buckets, bits), n)
    return corpus.join(sample, keys).select(
        "bucket_id", "row_id", "pos", *[c for c in corpus.columns if c != "row_id"]
    )
