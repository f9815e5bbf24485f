"""Vectors as exact integers: whole rows, floors, and sums over all partitions.

Integers are numpy's 64-bit ones where a bound on every intermediate result proves that they can't overflow, and Python's
unbounded ones otherwise, in the same expressions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this bound sums of 64-bit integers are exact, with room for a factor of two.
LONG = 1 << 62


def whole(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vec_col).isNotNull() & ok)


def floors(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as integers; ``scale`` is a power of two, so only the floor rounds."""
    x = np.asarray(x, np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.all(np.abs(y) < LONG):
        return y.astype(np.int64)
    out = np.empty(x.shape, object)
    out[...] = np.array([int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x.ravel().tolist()], object).reshape(x.shape)
    return out


def largest(*arrays: np.ndarray) -> int:
    """The largest magnitude."""
    return max((int(max(-a.min(), a.max())) for a in arrays if a.size), default=0)


def wide(x: np.ndarray, exact: bool) -> np.ndarray:
    """The same integers, unbounded unless 64 bits are exact."""
    return x if exact else x.astype(object)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of one length."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def group_sums(x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k x d sums as unbounded integers, k counts) of the rows of each group."""
    out, count = np.zeros((k, x.shape[1]), object), np.bincount(group, minlength=k)
    if len(x):
        order = np.argsort(group, kind="stable")
        used = np.flatnonzero(count)
        rows = wide(x, largest(x) * len(x) < LONG)[order]
        out[used] = np.add.reduceat(rows, (np.cumsum(count) - count)[used], axis=0).astype(object)
    return out, count.astype(object)


def tree_sum(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, ...]], zero: tuple[np.ndarray, ...], depth: int = 2) -> tuple[np.ndarray, ...]:
    """Sums over all partitions of the arrays that ``part`` makes of one, added up in a tree of tasks; the arrays' size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part(batches))], pa.binary())], names=["sums"])

    def add(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return tuple(x + y for x, y in zip(a, b))

    return df.mapInArrow(run, "sums binary").rdd.map(lambda r: pickle.loads(r.sums)).treeAggregate(zero, add, add, depth)
