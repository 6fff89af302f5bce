"""Vectors as fixed-width rows: which take part, and their matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(df: DataFrame, column: str) -> list[int]:
    """The lengths of usable vectors, in order: one row a length comes to the driver."""
    of = df.where(usable(F.col(column))).groupBy(F.size(column).alias("d")).count()
    return sorted(r["d"] for r in of.collect())


def comparable(v: Column, d: int) -> Column:
    """Usable and of this length; vectors are compared with those of their own length."""
    return usable(v) & (F.size(v) == d)


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """n x d doubles of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
