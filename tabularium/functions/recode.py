"""Codes to classes and labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from .text import literal, literals


def first_match(cases: Sequence[tuple[str, Any]], otherwise: str | None = None) -> str:
    """Value of the first case whose test is true; ``otherwise`` is an expression.

    An unknown test is no match.
    """
    whens = " ".join(f"WHEN {test} THEN {literal(value)}" for test, value in cases)
    default = "" if otherwise is None else f" ELSE {otherwise}"
    return f"CASE {whens}{default} END"


def band(
    col: str,
    ranges: Sequence[tuple[int, int, str]],
    special: Mapping[int, str] | None = None,
    otherwise: str | None = None,
) -> str:
    """Label of the inclusive range a number falls in, then of the special code it equals."""
    cases = [(f"{col} BETWEEN {lo} AND {hi}", label) for lo, hi, label in ranges]
    cases += [(f"{col} = {literal(code)}", label) for code, label in (special or {}).items()]
    return first_match(cases, otherwise)


def recode(col: str, classes: Sequence[tuple[Iterable, str]], otherwise: str | None = None) -> str:
    """Label of the first code set that holds the value."""
    return first_match([(f"{col} IN {literals(codes)}", label) for codes, label in classes], otherwise)


def label_map(col: str, labels: Mapping[str, str]) -> str:
    """Replace whole labels; a label that is not listed stays as it is."""
    return first_match([(f"{col} = {literal(old)}", new) for old, new in labels.items()], col)


def repair_text(col: str) -> str:
    """Undo UTF-8 that was read as Latin-1, and leave every other text alone.

    Only a text made of Latin-1 characters that holds a lead byte followed by a continuation byte is
    looked at, and it is replaced only when the bytes are valid UTF-8.
    """
    latin = literal(r"^[\x{00}-\x{FF}]*$")
    broken = literal(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
    # encode() fails on text that Latin-1 cannot hold; CASE keeps such text away from it
    raw = f"cast(CASE WHEN {col} RLIKE {latin} THEN encode({col}, 'ISO-8859-1') END AS STRING)"
    return (
        f"CASE WHEN {col} RLIKE {broken} AND {col} RLIKE {latin} AND is_valid_utf8({raw})"
        f" THEN {raw} ELSE {col} END"
    )
