"""Casualties by week-time class."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import band, codes, first_match, literal, literals, recode
from ..operators import group_count
from ..sources import year_bounds

SUNDAY, FRIDAY, SATURDAY = 1, 6, 7


def weektime_class(weekday: str, hour: str) -> str:
    """Weekend or week, day or night. Friday evening opens the weekend; unknown times are week nights."""
    by_day = f"{hour} BETWEEN 6 AND 17"
    early, late = f"{hour} BETWEEN 0 AND 5", f"{hour} BETWEEN 18 AND 24"
    weekend = f"{weekday} IN {literals([SUNDAY, SATURDAY])}"
    weekend_evening = f"{weekday} IN {literals([FRIDAY, SATURDAY])}"
    return first_match(
        [
            (f"{weekend} AND {by_day}", "weekend dag"),
            (by_day, "week dag"),
            (f"({weekend} AND {early}) OR ({weekend_evening} AND {late})", "weekendnacht"),
        ],
        literal("week nacht"),
    )


def weektime_table(
    casualties: DataFrame, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Casualties per outcome, mode, age, sex, week-time class and opponent.

    ``casualties`` has ``ernstsl, ote_sl, lftsl, sexesl, weekdag, uur, botspartner``. An opponent is
    told only for pedestrians and cyclists. ``first_year`` and ``last_year`` bound the scan (``jaar``).
    """
    casualties = casualties.where(year_bounds("jaar", first_year, last_year))
    mode = recode("ote_sl", codes.WEEKTIME_MODES, literal("Anders"))
    vulnerable = literals(label for _, label in codes.WEEKTIME_MODES[:2])
    opponent = recode("botspartner", codes.WEEKTIME_OPPONENTS, literal("anders"))
    coded = casualties.selectExpr(
        f"{recode('ernstsl', codes.WEEKTIME_OUTCOMES)} AS ernst",
        f"{mode} AS vvm",
        f"{band('lftsl', codes.AGE_BANDS_WEEKTIME, otherwise=literal('onbekend'))} AS kleeft",
        f"{recode('sexesl', codes.WEEKTIME_SEXES, literal('Onbekend'))} AS geslacht",
        f"{weektime_class('weekdag', 'uur')} AS tijd",
        f"CASE WHEN {mode} IN {vulnerable} THEN {opponent} ELSE 'nvt' END AS tegenp",
    )
    return group_count(coded, *coded.columns)
