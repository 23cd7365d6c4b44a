"""Integer vectors in blocks, for the operators that scan them: quantised once, packed, kept in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the smallest signed integers that hold a block's components.
WIDTHS = ((1 << 7, "<i1"), (1 << 15, "<i2"), (1 << 31, "<i4"))


def finite(vec_col: str) -> Column:
    """Whether a vector is not null and holds finite numbers alone."""
    v = F.col(f"`{vec_col}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def scaled(vec_col: str, scale: float) -> Column:
    """floor(scale * x) of each component, x as double, as integers of 64 bits; values beyond them are an error."""
    return F.transform(F.col(f"`{vec_col}`"), lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def matrices(batch: pa.RecordBatch, column: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length in a batch's list column."""
    v = batch.column(column)
    lens, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    ends, out = np.cumsum(lens), []
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        out.append((rows, flat[(ends[rows] - d)[:, None] + np.arange(d)] if d else np.zeros((len(rows), 0), np.int64)))
    return out


def narrow(x: np.ndarray) -> tuple[bytes, str]:
    """An integer matrix as bytes, and their type."""
    most = int(np.abs(x).max(initial=0))
    kind = next((k for limit, k in WIDTHS if most < limit), "<i8")
    return x.astype(kind).tobytes(), kind


def wide(raw: bytes, kind: str, dim: int, rows: int) -> np.ndarray:
    """The matrix that ``narrow`` packed, as 64-bit integers."""
    return np.frombuffer(raw, kind).astype(np.int64).reshape(rows, dim)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: by floating point where no sum can reach 2**53, which is exact and much faster."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a @ b.T

