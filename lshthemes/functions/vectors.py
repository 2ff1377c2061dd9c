"""Vector helpers that run on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows holding exactly ``dim`` components as one float64 matrix, and the mask of those rows."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    flat = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim), fits.to_numpy(zero_copy_only=False)


def column_or_none(values: np.ndarray, fits: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Spread ``values`` over the rows where ``fits`` holds; the others become null."""
    out = np.zeros(len(fits), dtype=values.dtype)
    out[fits] = values
    return pa.array(out, type=kind, mask=~fits)


def evaluated_once(function):
    """Keep a costly function where it is called.

    The optimizer moves a filter on a deterministic result below it and then evaluates the function twice,
    in the filter and again for the column.
    """
    return function.asNondeterministic()


def infer_dim(df: DataFrame, vec: str = "embedding") -> int:
    """The width of all vectors of a table, from one count over all of it. Raises where there are several widths; pass
    ``dim`` yourself to choose one, or to save the count."""
    width = F.when(F.size(vec) > 0, F.size(vec))
    low, high = df.agg(F.min(width), F.max(width)).first()
    if low is None:
        raise ValueError(f"column {vec!r} holds no vectors, so dim must be given")
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components, so dim must be given")
    return low


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two vector columns; NULL where it is undefined."""

    @F.arrow_udf(T.DoubleType())
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        n = len(left)
        out, known = np.zeros(n), np.zeros(n, dtype=bool)
        widths = pc.fill_null(pc.list_value_length(left), -1).to_numpy(zero_copy_only=False)
        for dim in np.unique(widths[widths > 0]):
            x, fits_x = batch_matrix(left, int(dim))
            y, fits_y = batch_matrix(right, int(dim))
            both = fits_x & fits_y
            x, y = x[both[fits_x]], y[both[fits_y]]
            with np.errstate(all="ignore"):
                norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                values = np.einsum("ij,ij->i", x, y) / norms
            out[both], known[both] = values, np.isfinite(values)
        return pa.array(out, mask=~known)

    return similarity(a, b)


def project(vec: Column | str, axes: np.ndarray) -> Column:
    """Project vectors on three axes, giving ``STRUCT<x, y, z>``; NULL for unusable vectors."""
    dim = axes.shape[1]

    @F.arrow_udf("x double, y double, z double")
    def place(vectors: pa.Array) -> pa.Array:
        matrix, fits = batch_matrix(vectors, dim)
        points = matrix @ axes.T
        parts = [column_or_none(points[:, i], fits, pa.float64()) for i in range(3)]
        return pa.StructArray.from_arrays(parts, names=["x", "y", "z"], mask=pa.array(~fits))

    return place(vec)
