"""Literals, and joining values into text."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

MISSING = "NA"


def literal(value: Any) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value)
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def literals(values: Iterable[Any]) -> str:
    """Python values as a SQL list."""
    return f"({', '.join(literal(v) for v in values)})"


def paste(*cols: str, sep: str = " ") -> str:
    """Join values with a separator; a missing value is written as ``NA``."""
    parts = ", ".join(f"coalesce(cast({c} AS STRING), {literal(MISSING)})" for c in cols)
    return f"concat_ws({literal(sep)}, {parts})"


def period_text(first: str, last: str) -> str:
    """``first-last``, empty when both are missing."""
    return f"CASE WHEN {first} IS NULL AND {last} IS NULL THEN '' ELSE {paste(first, last, sep='-')} END"
