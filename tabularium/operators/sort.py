"""Sorting with missing values last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrange(df: DataFrame, *keys: str, drop: list[str] | None = None) -> DataFrame:
    """Sort ascending, or descending for a key written ``-key``; missing values always come last.

    ``drop`` names sort keys that the output leaves out. Use it last before a write: a sort in the
    middle of a plan costs a shuffle and is undone by the next one.
    """
    order = [
        F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys
    ]
    out = df.orderBy(*order)
    return out.drop(*drop) if drop else out
