"""Query text with named markers: values and names are bound by Spark, never pasted into the text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

OPERATORS = {"=", "<>", "<", "<=", ">", ">=", "<=>", "IN", "LIKE", "BETWEEN", "IS NULL", "IS NOT NULL"}


def sql_scan(spark: SparkSession, text: str, values: Mapping[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Run ``text`` with ``:name`` markers bound to ``values``, and ``{name}`` standing for a DataFrame.

    ``IDENTIFIER(:name)`` takes a column or table name from a value.
    """
    return spark.sql(text, args=dict(values or {}), **frames)


def statement(
    table: str | DataFrame,
    columns: Sequence[str] | Mapping[str, str],
    tests: Sequence[tuple] = (),
) -> tuple[str, dict[str, Any], dict[str, DataFrame]]:
    """Text, values and frames of a scan, for :func:`sql_scan`: a column list (or new name to column) and tests.

    A test is ``(column, operator, *values)``; a row has to pass all. ``table`` is the name of a catalogue table or a
    DataFrame. An operator outside ``OPERATORS`` is an error, as it would stand in the text as it is.
    """
    values: dict[str, Any] = {}

    def name(column: str) -> str:
        marker = f"c{len(values)}"
        values[marker] = f"`{column.replace('`', '``')}`"
        return f"IDENTIFIER(:{marker})"

    def value(given: Any) -> str:
        marker = f"v{len(values)}"
        values[marker] = given
        return f":{marker}"

    named = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    # a new name cannot be a marker; it is an identifier in backquotes
    chosen = ", ".join(f"{name(old)} AS `{new.replace('`', '``')}`" for new, old in named.items())
    frames = {} if isinstance(table, str) else {"source": table}
    if isinstance(table, str):
        values["table"] = table
    passed = []
    for column, operator, *given in tests:
        op = operator.upper()
        if op not in OPERATORS:
            raise ValueError(f"operator {operator!r}")
        markers = [value(v) for v in given]
        if op == "IN":
            right = f"({', '.join(markers) or 'NULL'})"
        elif op == "BETWEEN":
            right = " AND ".join(markers)
        else:
            right = "".join(markers)
        passed.append(f"{name(column)} {op} {right}".rstrip())
    where = f" WHERE {' AND '.join(passed)}" if passed else ""
    source = "IDENTIFIER(:table)" if isinstance(table, str) else "{source}"
    return f"SELECT {chosen} FROM {source}{where}", values, frames


def parameter_scan(
    spark: SparkSession, table: str | DataFrame, columns: Sequence[str] | Mapping[str, str], tests: Sequence[tuple] = ()
) -> DataFrame:
    """Scan by a text that is put together at run time, see :func:`statement`."""
    text, values, frames = statement(table, columns, tests)
    return sql_scan(spark, text, values, **frames)
