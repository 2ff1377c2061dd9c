"""Keys that very many rows share, cut into blocks so that no task has to hold one of them whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from one row in so many on, so there are fewer hot keys than that, which bounds what is broadcast.
HOT_SHARE = 64
# And only if it has so many rows: fewer are no burden to one task.
HOT_ROWS = 100_000


def hot_keys(sizes: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, size: str = "size") -> DataFrame:
    """``(keys, blocks)`` of the hot keys of a table with one row and ``size`` for each key. A block is as large as a key
    may be without being hot."""
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).scalar()
    most = F.greatest(F.floor(total / HOT_SHARE), F.lit(hot_rows))
    return sizes.where(F.col(size) > most).select(*keys, F.ceil(F.col(size) / most).cast("int").alias("blocks"))


def with_blocks(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the number of ``blocks`` of their key, 1 for most."""
    joined = rows.join(F.broadcast(hot), list(keys), "left")
    return joined.withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def own_block(*identity: str) -> Column:
    """The block of a row, from what tells it apart from others of its key."""
    return F.pmod(F.xxhash64(*identity), F.col("blocks")).cast("int")


def every_block() -> Column:
    """A copy of the row for each block of its key."""
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
