"""Building the bucket index and describing its density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.hashing import (
    BASE_BITS,
    HASH_BITS,
    SEED,
    checked_bits,
    hash_vectors,
    hyperplanes,
    low_bits,
)
from lshthemes.functions.vectors import infer_dim


def build_index(
    corpus: DataFrame,
    bits: int = BASE_BITS,
    seed: int = SEED,
    dim: int | None = None,
    carry: Sequence[str] = (),
    file_path: str = "corpus",
    strict: bool = False,
) -> DataFrame:
    """One row per usable corpus row: its bucket, full hash and identity.

    ``carry`` stores further corpus columns in the index. With the vector and the columns to show carried,
    a search reads the rows of its buckets and joins nothing. Rows whose vector does not fit are left out
    (``index_health`` counts them) unless ``strict``. Without ``dim`` all vectors must have one width.
    """
    checked_bits(bits)
    dim = dim or infer_dim(corpus)
    hashed = hash_vectors(corpus, hyperplanes(dim, max(bits, HASH_BITS), seed), strict=strict)
    path = F.col("file_path") if "file_path" in corpus.columns else F.lit(file_path)
    return hashed.where(F.col("hash").isNotNull()).select(
        low_bits("hash", bits).alias("bucket_id"),
        "hash",
        path.alias("file_path"),
        "row_id",
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(dim).cast("bigint").alias("dim"),
        F.lit(bits).cast("bigint").alias("bits"),
        *carry,
    )


def identity(index: DataFrame, corpus: DataFrame) -> list[str]:
    """Columns that name a row in both tables.

    Positions repeat from file to file. An index over several files can only be matched with a corpus that names the
    files too; without that this raises.
    """
    if "file_path" not in index.columns:
        return ["row_id"]
    if "file_path" in corpus.columns:
        return ["file_path", "row_id"]
    low, high = index.agg(F.min("file_path"), F.max("file_path")).first()
    if low != high:
        raise ValueError("the index holds rows of several files, and the corpus does not say which row is from which")
    return ["row_id"]


def count_entries(index: DataFrame) -> Column:
    """Entries of a group of index rows. In place of an index, whatever only counts takes its manifest, whose rows say how
    many entries they stand for."""
    return F.sum("entries") if "entries" in index.columns else F.count("row_id")


def bucket_sizes(index: DataFrame) -> DataFrame:
    """Entries per bucket. Rows meet in partial sums, so a hot bucket moves one row per task."""
    return index.groupBy("bucket_id").agg(count_entries(index).alias("size"))


def dense_buckets(index: DataFrame, min_count: int = 5, top_n: int | None = None) -> DataFrame:
    """Buckets of at least ``min_count`` entries, the largest first."""
    dense = (
        bucket_sizes(index)
        .where(F.col("size") >= min_count)
        .select("bucket_id", F.col("size").alias("count"))
        .orderBy(F.desc("count"), "bucket_id")
    )
    return dense if top_n is None else dense.limit(top_n)


def index_stats(index: DataFrame, capacity: int = 256) -> DataFrame:
    buckets = F.count(F.lit(1))
    return bucket_sizes(index).agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_entries"),
        buckets.alias("num_buckets"),
        F.avg("size").alias("avg_bucket_size"),
        (buckets / F.lit(capacity)).alias("load_factor"),
    )


def bucket_size_histogram(index: DataFrame) -> DataFrame:
    """How many buckets have each size, the largest size first."""
    return (
        bucket_sizes(index)
        .groupBy("size")
        .agg(F.count("bucket_id").alias("count"))
        .orderBy(F.desc("size"))
    )


def density_stats(index: DataFrame, threshold: int = 10) -> DataFrame:
    return bucket_sizes(index).agg(
        F.count(F.lit(1)).alias("num_buckets"),
        F.avg("size").alias("avg_size"),
        F.max("size").alias("max_size"),
        F.count_if(F.col("size") >= threshold).alias("dense_buckets"),
        F.count_if(F.col("size") < threshold).alias("sparse_buckets"),
    )


def inverted_lists(index: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """Sorted row ids of each bucket, in chunks that each cover ``chunk_rows`` consecutive ids.

    A chunk bounds the length of its list however large the bucket is; read by ``chunk``, the lists of a
    bucket follow each other in order.
    """
    return (
        index.where(F.col("row_id").isNotNull())
        .withColumn("chunk", F.floor(F.col("row_id") / chunk_rows).cast("bigint"))
        .groupBy("bucket_id", *[c for c in ("file_path",) if c in index.columns], "chunk")
        .agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))
    )


def dangling_entries(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """Index entries that point at no corpus row."""
    keys = identity(index, corpus)
    return index.where(F.col("row_id").isNotNull()).join(corpus.select(*keys), keys, "left_anti")


def index_health(index: DataFrame, corpus: DataFrame, dim: int) -> DataFrame:
    """What lookups pass over in silence: null ids, dangling ids, vectors of the wrong width."""
    zero = F.lit(0).cast("bigint")
    unfit = ~F.coalesce(F.size("embedding") == dim, F.lit(False))
    counts = [
        index.agg(F.count_if(F.col("row_id").isNull()).alias("null_rows")),
        dangling_entries(index, corpus).agg(F.count(F.lit(1)).alias("dangling_rows")),
        corpus.agg(F.count_if(unfit).alias("bad_vectors")),
    ]
    names = ("null_rows", "dangling_rows", "bad_vectors")
    rows = [
        c.select(*[F.col(n) if n in c.columns else zero.alias(n) for n in names]) for c in counts
    ]
    return (
        rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.sum(n).alias(n) for n in names])
    )
