"""What the embedding operators share: usable vectors, second moments, block sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Not null, not empty, not zero, no component null or not finite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a double matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and second moment of unit vectors, from all rows: one row of sums a partition, added up in two steps."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = rows_of(b.column(0))
            if len(x):
                x = x / np.linalg.norm(x, axis=1)[:, None]
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                s += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((dim + 1) ** 2)
        for b in batches:
            for x in b.column(0):
                s += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    parts = vectors.mapInArrow(sums, "s binary").repartition(16).mapInArrow(again, "s binary").collect()
    s = sum((np.frombuffer(r["s"]) for r in parts), np.zeros((dim + 1) ** 2)).reshape(dim + 1, dim + 1)
    return int(round(s[0, 0])), s[0, 1:], s[1:, 1:]
