"""Vector columns, and vector batches inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; null when a vector has no length."""
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit_rows(vectors) -> np.ndarray:
    """A batch of lists as a matrix of unit rows."""
    matrix = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    if matrix.size == 0:
        return matrix.reshape(0, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest per row, ties by id: ``(distances, ids)``, each rows x k."""
    ids = np.broadcast_to(ids, distance.shape)
    order = np.lexsort((ids, distance), axis=1)[:, :k]
    return np.take_along_axis(distance, order, 1), np.take_along_axis(ids, order, 1)
