"""Appending tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def append(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables that have the same columns, in any order."""
    wanted = {c.lower() for c in first.columns}
    for df in others:
        found = {c.lower() for c in df.columns}
        if found != wanted:
            raise ValueError(f"columns differ: {sorted(found ^ wanted)}")
    return reduce(DataFrame.unionByName, others, first)


def append_filled(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables; a column that one of them lacks is missing in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def two_periods(old: DataFrame, new: DataFrame, year: str, cutover: int, *late: DataFrame) -> DataFrame:
    """One series from two sources: ``old`` before the cut-over year, ``new`` from it on.

    ``late`` tables are reports that the old source missed; they are kept whatever their year. One
    cut-over year serves both sides, so no year is counted twice.
    """
    return append_filled(old.where(f"{year} < {cutover}"), *late, new.where(f"{year} >= {cutover}"))
