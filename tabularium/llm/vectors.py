"""Which vectors take part in a search or comparison, and vectors as numbers inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vec: str) -> Column:
    """Whether a vector can have a cosine: there, not empty, finite throughout and not all zero."""
    wrong = f"exists({vec}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    return F.expr(f"{vec} IS NOT NULL AND size({vec}) > 0 AND NOT coalesce({wrong}, true) AND exists({vec}, x -> x != 0)")


def common_size(df: DataFrame, vec: str) -> int:
    """The one length of the vectors of a table (0 for an empty table); vectors of two lengths are an error."""
    low, high = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and {high} components in one table")
    return low or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large or small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
