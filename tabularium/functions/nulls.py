"""Predicates with a fixed answer for missing values."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .text import literal, literals


def member(col: str, values: Iterable) -> str:
    """``col`` is one of ``values``; a missing value is in no list, so FALSE and never NULL."""
    return f"coalesce({col} IN {literals(values)}, false)"


def lacks_text(col: str, *markers: str) -> str:
    """None of the markers occurs in ``col``. Missing text holds no marker, so it passes.

    Markers are literal: an underscore is an underscore. All are looked for in one pass.
    """
    pattern = literal("|".join(re.escape(m) for m in markers))
    return f"({col} IS NULL OR NOT {col} RLIKE {pattern})"


def lacks_prefix(col: str, *prefixes: str) -> str:
    """``col`` starts with none of the prefixes, or is missing."""
    return " AND ".join(f"({col} IS NULL OR NOT startswith({col}, {literal(p)}))" for p in prefixes)


def lacks_code(col: str, *codes) -> str:
    """``col`` is none of the codes, or is missing."""
    return f"({col} IS NULL OR {col} NOT IN {literals(codes)})"


def strict_if(test: str, yes: str, no: str) -> str:
    """Two-way choice between two expressions that is missing where the test is unknown."""
    return f"CASE WHEN {test} THEN {yes} WHEN NOT ({test}) THEN {no} END"
