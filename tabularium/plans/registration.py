"""Registration rate: which share of the true numbers was registered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, percentage
from ..operators import arrange, left_lookup, reshape_wide
from ..operators.aggregate import reconcile_measures, total
from .dimensions import variable_lookup

DEATHS = 1
FIRST_YEAR = 1996


def rate_table(
    source: DataFrame,
    key: str,
    lookup: DataFrame,
    first_year: int = FIRST_YEAR,
    last_year: int | None = None,
    severity: int = DEATHS,
    ordered: bool = True,
) -> DataFrame:
    """Registered and true numbers of one breakdown with the rate in percent.

    ``source`` has ``JAAR, LETSELERNST_IVO2, SLA_VOR, SLA_IVO`` and the key; ``lookup`` is keyed by
    ``code`` and holds the labels. ``ordered`` sorts by year and code, for a table that goes to a file.
    """
    wanted = f"LETSELERNST_IVO2 = {severity} AND JAAR >= {first_year}"
    if last_year is not None:
        wanted += f" AND JAAR <= {last_year}"
    rows = source.where(wanted).selectExpr(
        "JAAR AS Jaar", f"{key} AS sleutel", "SLA_IVO AS Werkelijk", "SLA_VOR AS Geregistreerd"
    )
    labels = [c for c in lookup.columns if c != "code"]
    named = left_lookup(rows, lookup, {"sleutel": "code"})
    if ordered:
        named = arrange(named, "Jaar", "sleutel")
    rate = percentage("Geregistreerd", "Werkelijk")
    return named.selectExpr("Jaar", *labels, "Werkelijk", "Geregistreerd", f"{rate} AS Registratiegraad")


def rate_tables(
    sources: Mapping[str, DataFrame],
    codebook: DataFrame,
    years: Mapping[str, tuple[int, int | None]] | None = None,
    ordered: bool = True,
) -> dict[str, DataFrame]:
    """The published tables, by sheet name.

    ``sources`` gives the pre-counted table of each key column. ``years`` replaces the published years
    of single sheets; the weekday and hour sheets have shorter periods than the others.
    """
    out = {}
    for sheet, (key, variable, first, last) in codes.RATE_TABLES.items():
        first, last = (years or {}).get(sheet, (first, last))
        out[sheet] = rate_table(
            sources[key], key, variable_lookup(codebook, variable), first, last, ordered=ordered
        )
    return out


def rate_wide(rated: DataFrame, measure: str, years: Sequence[int], prefix: str = "") -> DataFrame:
    """One measure of a rate table with a column per year."""
    others = {"Werkelijk", "Geregistreerd", "Registratiegraad"} - {measure}
    return reshape_wide(rated.drop(*others), "Jaar", measure, years, prefix)


def reconcile_rates(breakdowns: Mapping[str, DataFrame]) -> DataFrame:
    """Yearly totals of the true and the registered numbers (``maat``) over all breakdowns, each read once."""
    return reconcile_measures(breakdowns, "Jaar", ["Werkelijk", "Geregistreerd"])


def yearly_rate(source: DataFrame, registered: str, true: str, year: str = "Jaar") -> DataFrame:
    """Yearly totals and the rate as a fraction; missing where the true number is 0."""
    sums = source.groupBy(year).agg(
        F.expr(f"{total(true)} AS Werkelijk"), F.expr(f"{total(registered)} AS Geregistreerd")
    )
    share = "try_divide(cast(Geregistreerd AS DOUBLE), cast(Werkelijk AS DOUBLE))"
    return sums.selectExpr("*", f"{share} AS Registratiegraad")
