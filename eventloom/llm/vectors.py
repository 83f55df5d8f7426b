"""Vectors of whole numbers, as the clustering and the compression of embeddings use them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held at this bound, so that every squared distance of up to 4,096 components fits a long.
BOUND = 1 << 24


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def narrowed(table: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """``vec_id, v`` and ``others``, of the rows with a usable vector; ``v`` is an array of doubles."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *others)
    return rows.where(usable(F.col("v")))


def whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """A row of integers ``floor(scale * x)`` for each vector of ``dim`` components."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(values * float(scale)), -BOUND, BOUND).astype(np.int64)


def whole_row(vector: list[float], scale: int) -> list[int]:
    return [max(-BOUND, min(BOUND, math.floor(scale * x))) if abs(x) < BOUND else int(math.copysign(BOUND, x)) for x in vector]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all rows of ``b``, exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        diff = a[:, i, None] - b[None, :, i]
        out += diff * diff
    return out
