"""Vector functions.

Pair-wise arithmetic runs on whole Arrow batches with numpy: about four times
faster than ``zip_with``/``aggregate``, which box every element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest denominator of a cosine (fixed value of the loss function).
COSINE_FLOOR = 1e-8


def slice_dims(col: Column, d: int) -> Column:
    """The first ``d`` dimensions."""
    return F.slice(col, 1, d)


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """A list array of equally long vectors as a double matrix."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    if vectors.null_count:
        raise ValueError("null vector")
    lengths = np.diff(vectors.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), int(lengths[0]))


def as_lists(matrix: np.ndarray, value_type: pa.DataType = pa.float64()) -> pa.Array:
    """The rows of a matrix as a list array."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(dim))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=value_type))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their length; zero rows stay zero."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def l2_normalize(col: Column) -> Column:
    """E5: divide by the L2 norm; a zero vector stays zero."""

    @F.arrow_udf("array<double>")
    def normalize(vectors: pa.Array) -> pa.Array:
        return as_lists(unit_rows(as_matrix(vectors)))

    return normalize(col)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; the longer one is cut to the shorter. Zero vectors give 0."""

    @F.arrow_udf("double")
    def pair_cosine(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = as_matrix(left), as_matrix(right)
        d = min(x.shape[1], y.shape[1])
        x, y = x[:, :d], y[:, :d]
        dot = np.einsum("ij,ij->i", x, y)
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return pa.array(dot / np.maximum(norms, COSINE_FLOOR))

    return pair_cosine(a, b)
