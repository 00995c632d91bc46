"""Number parsing, rounding and rates."""

from __future__ import annotations


def to_int(col: str) -> str:
    """Whole number in a text; missing when the text is no number. A fraction is cut off."""
    return f"try_cast(try_cast({col} AS DOUBLE) AS INT)"


def round_to(col: str, digits: int = 1) -> str:
    """Round to the nearer of the two neighbouring ``digits``-decimal values, ties to the even one.

    The distance is taken between doubles, so the result is the decimal value that the stored number
    is really nearest to: 84.25 gives 84.2 and 0.15 gives 0.1 (0.15 is stored just below the tie).
    """
    scale = f"{10**digits}D"
    low, high = f"floor({col} * {scale}) / {scale}", f"ceil({col} * {scale}) / {scale}"
    return (
        f"CASE WHEN {col} - {low} < {high} - {col} THEN {low}"
        f" WHEN {col} - {low} > {high} - {col} THEN {high}"
        f" WHEN floor({col} * {scale}) % 2 = 0 THEN {low} ELSE {high} END"
    )


def percentage(part: str, whole: str, digits: int = 1) -> str:
    """``100 * part / whole``, rounded. Missing when the whole is 0 or missing."""
    return round_to(f"try_divide(cast({part} AS DOUBLE) * 100, cast({whole} AS DOUBLE))", digits)
