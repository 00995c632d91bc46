"""Table scans. Projection and predicate are left to Catalyst, which hands them to the source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import literal
from .shared import settings

# with it on, counts, minima and maxima of stored columns are taken from the footers of the files
FOOTERS = {"spark.sql.parquet.aggregatePushdown": "true"}


def scan(
    spark: SparkSession,
    path: str | None = None,
    *,
    table: str | None = None,
    columns: Sequence[str] | Mapping[str, str] | None = None,
    where: Column | str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Read a table, keep the rows of ``where`` and the listed columns.

    Give ``path`` for files, ``table`` for a catalogue table, or ``fmt="jdbc"`` with the connection
    in ``options`` for a database (``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` split that read over tasks).

    ``columns`` is a list, or a mapping from new name to source column; one source column may appear
    under several names. ``where`` speaks of source columns.
    """
    if table is not None:
        df = spark.table(table)
    else:
        reader = spark.read.format(fmt).options(**dict(options or {}))
        df = reader.load(path) if path is not None else reader.load()
    if where is not None:
        df = df.where(where)
    if columns is None:
        return df
    named = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return df.selectExpr(*[f"`{old}` AS `{new}`" for new, old in named.items()])


def footer_scan(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table through the reader that can answer aggregates itself.

    Row counts, minima and maxima of stored numbers, dates and flags then come out of the file footers, and no column is
    read, when the job runs under ``FOOTERS`` (see :func:`settings`), without a filter and without derived columns.
    """
    listed = spark.conf.get("spark.sql.sources.useV1SourceList")
    others = ",".join(name for name in listed.split(",") if name.strip().lower() != "parquet")
    with settings(spark, {"spark.sql.sources.useV1SourceList": others}):
        return spark.read.parquet(path)


def year_range(col: str, first: int | None = None, last: int | None = None) -> str:
    """The date or timestamp column falls in the years ``first`` to ``last``, both included.

    Written as bounds on the column itself, which take the type of the column, so row groups outside
    the years are skipped; ``year(col) = y`` would read them all.
    """
    bounds = []
    if first is not None:
        bounds.append(f"{col} >= '{first:04}-01-01'")
    if last is not None:
        bounds.append(f"{col} < '{last + 1:04}-01-01'")
    return " AND ".join(bounds)


def year_bounds(col: str, first: int | None = None, last: int | None = None) -> str:
    """The same for a column that holds the year as a number; true without bounds."""
    bounds = [f"{col} {op} {int(y)}" for op, y in ((">=", first), ("<=", last)) if y is not None]
    return " AND ".join(bounds) or "true"


def tagged(df: DataFrame, **tags: Any) -> DataFrame:
    """Add literal columns, such as the year of a side file that does not hold it."""
    return df.selectExpr("*", *[f"{literal(value)} AS `{name}`" for name, value in tags.items()])
