"""Vectors of Arrow columns, for the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def matrices(column: pa.Array):
    """(row numbers, float64 matrix) for each length of the usable vectors: not null or empty, all components finite, not zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([-1 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), d)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield at[good], x[good]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
