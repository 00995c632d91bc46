"""Explanation sheets: free text and small tables in one ragged semicolon file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import literal


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; the first line only numbers the columns and bare ``NA`` is missing."""
    return spark.read.csv(path, sep=";", header=True, nullValue="NA", escape='"', multiLine=True)


def sheet_table(
    sheet: DataFrame,
    columns: Sequence[tuple[str, str]],
    first_cell: str = "^[0-9]{4}$",
) -> DataFrame:
    """The small table inside a sheet: rows whose first cell looks like a year.

    ``columns`` gives name and type of the leading sheet columns; further columns are left out.
    """
    # backquotes, because sheet columns are called ...1, ...2
    cells = [f"`{c}`" for c in sheet.columns]
    rows = sheet.where(f"{cells[0]} RLIKE {literal(first_cell)}")
    return rows.selectExpr(
        *[f"cast({cell} AS {kind}) AS {name}" for cell, (name, kind) in zip(cells, columns, strict=False)]
    )
