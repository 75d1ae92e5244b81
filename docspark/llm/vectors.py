"""Vectors in Arrow batches as whole numbers in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components at or beyond this are an error: sums of their products would leave 64 bits.
LARGEST = 1 << 27


def as_doubles(vec: str) -> Column:
    return F.col(f"`{vec}`").cast("array<double>")


def width_of(df: DataFrame, vec: str, multiple: int = 1) -> int:
    """The length of the longest vector, rounded up to a multiple; 0 without vectors."""
    longest = df.agg(F.max(F.size(f"`{vec}`"))).first()[0] or 0
    return -(-max(0, longest) // multiple) * multiple


def whole_numbers(column: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, floor(scale * x) of their vectors). A null vector, and one with a null or non-finite
    component, takes no part; shorter ones end in zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    offs = column.offsets.to_numpy()
    values = column.values.slice(offs[0], offs[-1] - offs[0])
    there = values.is_valid().to_numpy(zero_copy_only=False) if values.null_count else np.ones(len(values), bool)
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    there &= np.isfinite(x)
    sizes, row = np.diff(offs), np.repeat(np.arange(len(column)), np.diff(offs))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~there], minlength=len(column)) == 0)
    mine = ok[row]
    with np.errstate(over="ignore"):
        scaled = np.floor(x[mine] * scale)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more")
    out = np.zeros((int(ok.sum()), width), np.int64)
    place = np.arange(len(row)) - np.repeat(offs[:-1] - offs[0], sizes)
    out[(np.cumsum(ok) - 1)[row[mine]], place[mine]] = scaled
    return np.flatnonzero(ok), out


def packed(numbers: np.ndarray) -> bytes:
    """The numbers in as few bytes each as hold them; the first byte says how many."""
    most = max(-int(numbers.min()) - 1, int(numbers.max())) if numbers.size else 0
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + numbers.astype(f"<i{size}").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, max(1, width))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: by the floating-point unit where its 53 bits hold every sum."""
    most = lambda m: int(np.abs(m).max(initial=0))
    bound = most(a) * most(b) * a.shape[1]
    if bound < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("a score may leave 64 bits")
    return a @ b.T
