"""Joins to a table of unique keys where many rows may ask for the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one row in so many on, so there are fewer hot keys than this.
SHARE = 500


def look_up(rows: DataFrame, keys: Sequence[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key. Rows of hot keys stay where they are: the
    table's rows of those keys, fewer than ``SHARE``, are sent to them. ``rows`` is read several times, so store it."""
    keys = list(keys)
    total = rows.agg(F.count(F.lit(1))).scalar()
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_uses")).where(F.col("_uses") * SHARE > total).select(*keys)
    known = table.join(F.broadcast(hot), keys, "left_semi")
    often = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(known), keys, how)
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return often.unionByName(rest)
