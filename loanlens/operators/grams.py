"""Sums of products of columns, one pass and one small shuffle for any number of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Tasks whose sums are merged first.
BRANCHES = 64


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _merged(rows: DataFrame, add) -> list[np.ndarray]:
    """Arrays that ``add`` makes of each batch, summed as a tree; none for an empty frame."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = add(_arrays(batch))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"branch": pa.array([TaskContext.get().partitionId() % BRANCHES], pa.int32()), "sums": [total.ravel()]})

    def merged(part: pa.Table) -> pa.Table:
        return pa.table({"branch": part["branch"].slice(0, 1), "sums": [np.stack(part["sums"].to_numpy()).sum(0)]})

    kind = "branch int, sums array<double>"
    found = rows.select("x").mapInArrow(partial, kind).groupBy("branch").applyInArrow(merged, kind).collect()
    return [np.array(r["sums"]) for r in found]


def gram_matrix(rows: DataFrame) -> np.ndarray:
    """Sums of products of all pairs of elements of the array column ``x``, without gaps."""
    found = _merged(rows, lambda x: x.T @ x)
    total = np.sum(found, axis=0) if found else np.zeros(0)
    size = int(len(total) ** 0.5)
    return total.reshape(size, size)


def pairwise_sums(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """For all pairs (i, j) of elements of the array column ``x``, over the rows that have both:
    their number, the sums of x_i, of x_i squared and of x_i x_j. Gaps are null or NaN."""

    def add(x: np.ndarray) -> np.ndarray:
        has = (~np.isnan(x)).astype(float)
        z = np.nan_to_num(x)
        return np.stack([has.T @ has, z.T @ has, (z * z).T @ has, z.T @ z])

    found = _merged(rows, add)
    total = np.sum(found, axis=0) if found else np.zeros(0)
    size = int((len(total) / 4) ** 0.5)
    return tuple(total.reshape(4, size, size))
