"""Texts as compressed bytes, for where they have to be shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = 512


def packed(text: str) -> Column:
    """A text column compressed; null as the empty text."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                yield pa.array([tool.compress((x.as_py() or "").encode()) for x in batch.slice(first, ROWS)], pa.binary())

    return pack.asNondeterministic()(text)
