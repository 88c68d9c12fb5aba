"""Vectors of whole numbers, as the clustering and the exact search use them.

A component x becomes floor(scale * x) in double precision. Numbers beyond 2**62 either way count as 2**62: no square of
theirs fits a long, so neither would any distance or score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 1 << 62
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53


def usable(column: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~odd, F.lit(False))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -float(MOST), float(MOST)).astype(np.int64)


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column in order, and how many each row has."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold the largest of them."""
    most = largest(x)
    kind = next(k for k, bits in (("1", 7), ("2", 15), ("4", 31), ("8", 63)) if most < 1 << bits)
    return kind.encode() + x.astype(f"<i{kind}").tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64)
