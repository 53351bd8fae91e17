"""Vectors as whole numbers, and sums of them: shared by the operators that fit centroids exactly.

A component x becomes floor(SCALE * x). Numbers stay below ``LIMIT`` in size, so that sums over all
rows and squared distances fit 64 bits. Products run in doubles where these are exact, else in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, LIMIT = 256, 1 << 26


def vector_column(df: DataFrame, name: str) -> tuple[object, str]:
    """The column as an array of floats or doubles, and that type."""
    kind = df.schema[name].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    return F.col(f"`{name}`").cast(kind), kind


def finite(v: str):
    """True where a vector and all its components are there and finite."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def in_range(v: str):
    """True where every whole number is below ``LIMIT`` in size."""
    return F.forall(v, lambda x: F.abs(x.cast("double")) < LIMIT // SCALE)


def floors(col) -> np.ndarray:
    """An Arrow list column of equally long vectors as rows of whole numbers."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(col), -1)


def exact(*arrays: np.ndarray) -> type:
    """The type in which distances of these rows are exact: double if every sum stays below 2**53."""
    big = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    dims = max(a.shape[-1] for a in arrays)
    return np.float64 if 8 * dims * big * big < 1 << 53 else np.int64


def nearest_row(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row by squared distance, the first of equals, and that distance."""
    kind = exact(x, entries)
    a, c = x.astype(kind), entries.astype(kind)
    far = (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)
    best = far.argmin(axis=1)
    return best, (far[np.arange(len(a)), best] + (a * a).sum(axis=1)).astype(np.int64)


def sums_of(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Row sums for each of ``n`` places, the number of rows in the last column."""
    out = np.zeros((n, x.shape[1] + 1), np.int64)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    if len(order):
        out[at[order[first]], :-1] = np.add.reduceat(x[order], first, axis=0)
    out[:, -1] = np.bincount(at, minlength=n)
    return out


def slots(total: np.ndarray):
    """Non-zero entries of a flat array of sums as one batch of (slot, total)."""
    flat = total.reshape(-1)
    some = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["slot", "total"])


def gathered(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Tasks' (slot, total) rows added by slot; the result has as many rows as the array has numbers."""
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in parts.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[r["slot"]] = r["total"]
    return out.reshape(shape)


def floor_mean(old: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each row with a count, else the old row; the last column of ``sums`` has the counts."""
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :-1] // np.maximum(n, 1), old)


def decimals(rows: np.ndarray) -> str:
    """The numbers of an array in order, as decimal text with commas."""
    return ",".join(map(str, rows.reshape(-1).tolist()))
