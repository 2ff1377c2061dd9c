"""Turning text into vectors with an encoder of the user's choice.

An encoder is any picklable object with ``dim`` and ``encode(texts) -> matrix``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.vectors import evaluated_once

class _Slots(dict):
    """Slot of every word met: below ``dim`` it counts up, from there on down."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        number = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        slot = self[word] = number % self.dim + self.dim * (number // self.dim % 2)
        return slot


class TokenHashEncoder:
    """Signed bag of hashed words. The sums stay whole numbers, so every engine agrees on them."""

    # Words remembered in one task; forgetting them changes no vector.
    MAX_WORDS = 1 << 16

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._slots = _Slots(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        words = re.compile("[a-z0-9_]+").findall
        for i, text in enumerate(texts):
            slots = [self._slots[word] for word in words(text.lower())]
            if slots:
                counts = np.bincount(slots, minlength=2 * self.dim)
                out[i] = counts[: self.dim] - counts[self.dim :]
            if len(self._slots) > self.MAX_WORDS:
                self._slots.clear()
        return out


# Texts that are Python strings at a time.
ROWS = 512


def _vectors(texts: pa.Array, encoder) -> pa.Array:
    matrix = encoder.encode([t or "" for t in texts.to_pylist()])
    offsets = np.arange(0, matrix.size + 1, encoder.dim, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, matrix.astype(np.float32).ravel())


def encode(df: DataFrame, text_col: str, encoder, out: str = "embedding") -> DataFrame:
    """Add the vector of ``text_col``. The encoder is set up once per task, not per batch."""

    @F.arrow_udf("array<float>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = (batch.slice(first, ROWS) for first in range(0, len(batch), ROWS))
            yield from map(partial(_vectors, encoder=encoder), parts)

    return df.withColumn(out, evaluated_once(encoded)(text_col))
