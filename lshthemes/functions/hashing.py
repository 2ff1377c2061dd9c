"""Sign-random-projection hashing: planes, hashes, buckets and probes.

The planes come from a fixed seed, so indexes built apart share their bucket ids. Plane ``i`` does not
depend on how many planes are drawn: a short hash is the low end of a longer one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.vectors import batch_matrix, column_or_none, evaluated_once

SEED = 31
HASH_BITS = 16
BASE_BITS = 8
REFINE_BITS = 4

# A table keyed by ids of this many bits has at most 65,536 rows and may be broadcast.
BROADCAST_BITS = 16

# A hash is a signed 64-bit integer.
MOST_BITS = 62


def checked_bits(bits: int) -> int:
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"{bits} bits do not fit a hash of 1 to {MOST_BITS}")
    return bits


def hyperplanes(dim: int, n_bits: int = HASH_BITS, seed: int = SEED) -> np.ndarray:
    """``n_bits`` Gaussian planes of ``dim`` components."""
    return np.random.RandomState(seed).randn(n_bits, dim)


def sign_hash(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit ``i`` is set where the row lies strictly on the positive side of plane ``i``."""
    checked_bits(len(planes))
    weights = np.left_shift(np.int64(1), np.arange(len(planes), dtype=np.int64))
    with np.errstate(all="ignore"):
        return (matrix @ planes.T > 0) @ weights


def hash_vectors(
    df: DataFrame, planes: np.ndarray, vec: str = "embedding", strict: bool = False
) -> DataFrame:
    """Add ``hash``. Vectors of another width get NULL, or raise when ``strict``."""
    dim = planes.shape[1]
    checked_bits(len(planes))

    @F.arrow_udf("bigint")
    def hashed(vectors: pa.Array) -> pa.Array:
        matrix, fits = batch_matrix(vectors, dim)
        if strict and not fits.all():
            raise ValueError(f"{(~fits).sum()} vectors do not have {dim} components")
        return column_or_none(sign_hash(matrix, planes), fits, pa.int64())

    return df.withColumn("hash", evaluated_once(hashed)(vec))


def low_bits(value: Column | str, bits: int) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def level_one(value: Column | str, base_bits: int, refine_bits: int) -> Column:
    """The ``refine_bits`` bits that follow the bucket id."""
    return low_bits(F.shiftright(value, base_bits), refine_bits)


def with_buckets(
    df: DataFrame, base_bits: int = BASE_BITS, refine_bits: int = REFINE_BITS
) -> DataFrame:
    """Add ``bucket_id`` and ``level1``, cut from ``hash``."""
    return df.withColumns(
        {
            "bucket_id": low_bits("hash", base_bits),
            "level1": level_one("hash", base_bits, refine_bits),
        }
    )


def probe_masks(bits: int = BASE_BITS, radius: int = 2) -> list[int]:
    """XOR masks that reach every id within ``radius`` flipped bits, the id itself first."""
    return [
        sum(1 << i for i in flipped)
        for n in range(radius + 1)
        for flipped in combinations(range(bits), n)
    ]


def probe_list(bucket: Column | str, bits: int = BASE_BITS, radius: int = 2) -> Column:
    """The ids to probe for one bucket, as an array."""
    column = F.col(bucket) if isinstance(bucket, str) else bucket
    masks = F.array(*[F.lit(m).cast("bigint") for m in probe_masks(bits, radius)])
    return F.transform(masks, lambda mask: column.bitwiseXOR(mask))


def probe_buckets(df: DataFrame, bits: int = BASE_BITS, radius: int = 2) -> DataFrame:
    """One row per probe of each row's ``bucket_id``, in ``probe_bucket``."""
    return df.withColumn("probe_bucket", F.explode(probe_list("bucket_id", bits, radius)))


def bucket_hex(bucket: Column | str, width: int = 1) -> Column:
    """``0x`` form of an id; ``width`` pads with zeros and never cuts."""
    digits = F.lower(F.hex(bucket))
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit("0x"), padded)


def keyed_by_bucket(df: DataFrame, bits: int | None) -> DataFrame:
    """Broadcast a table with one row per id when the width of the ids bounds its size."""
    return F.broadcast(df) if bits is not None and bits <= BROADCAST_BITS else df
