"""Population by municipality, region, sex and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, literal, strict_if
from ..operators import arrange, group_sum, left_lookup, rollups, rollups_tagged
from ..operators.aggregate import spread
from .dimensions import add_age_labels

RECENT = [
    "Jaar",
    "Provincie",
    "Eenheid",
    "Politieregio",
    "gemeente_nr_recent",
    "Gemeente_naam_recent",
    "Geslacht",
    "Sex",
    "Leeftijd",
]
HISTORIC = [
    "Jaar",
    "Provincie",
    "Eenheid",
    "Politieregio",
    "gemeente_nr",
    "Gemeente_naam",
    "gemeente_nr_recent",
    "Gemeente_naam_recent",
]
REGION = ["Jaar", "Provincie", "Eenheid", "Politieregio", "Geslacht", "Sex"]


def population_base(population: DataFrame, sexes: DataFrame, regions: DataFrame) -> DataFrame:
    """Inhabitants per year, sex, single age and municipality, with labels.

    ``population`` has ``jaar, geslacht, lft_inw, gemeente_nr, aantal``; ``sexes`` translates ``code``
    to ``Geslacht`` and ``Sex``. The population is counted on the codes
    first, so labels are looked up for totals only. Before the first year with regions, all
    regional columns read unknown.
    """
    counted = group_sum(
        population, "jaar", "geslacht", "lft_inw", "gemeente_nr", measure="aantal", name="Inwoners"
    ).withColumnsRenamed({"jaar": "Jaar", "geslacht": "sexe_nr"})
    named = left_lookup(counted, sexes, {"sexe_nr": "code"})
    named = left_lookup(add_age_labels(named, "lft_inw"), regions, "gemeente_nr", unique=False)

    early = f"Jaar < {codes.FIRST_YEAR_WITH_REGIONS}"
    unknown, unknown_nr = literal(codes.UNKNOWN), literal(codes.UNKNOWN_MUNICIPALITY)
    no_unit = f"{early} OR Eenheid IS NULL OR gemeente_nr = {codes.MUNICIPALITY_WITHOUT_UNIT}"
    no_region = literal(f"{codes.UNKNOWN}/nvt")
    # one projection, so the unit still sees the municipality number as it came in
    masks = {
        "Provincie": strict_if(f"{early} OR Provincie IS NULL", unknown, "Provincie"),
        "Eenheid": strict_if(no_unit, unknown, "Eenheid"),
        "Politieregio": strict_if(f"{early} OR Politieregio IS NULL", no_region, "Politieregio"),
        "gemeente_nr": strict_if(early, unknown_nr, "gemeente_nr"),
        "Gemeente_naam": strict_if(early, unknown, "Gemeente_naam"),
        "gemeente_nr_recent": strict_if(early, unknown_nr, "gemeente_nr_recent"),
        "Gemeente_naam_recent": strict_if(early, unknown, "Gemeente_naam_recent"),
    }
    return named.selectExpr(
        "Jaar", *[f"{e} AS {c}" for c, e in masks.items()], "Geslacht", "Sex", "Leeftijd", "lft_inw", "Inwoners"
    )


LEVELS = {
    "Gemeenten_historisch": HISTORIC,
    "Gemeenten_recent_lft_sex": RECENT,
    "Inwoners_regio_leeftijd": [*REGION, "lft_inw"],
}


def population_cube(base: DataFrame) -> DataFrame:
    """The three published tables as one, with ``tabel`` for the name of each: one aggregate over the base.

    Single ages stand in ``lft_inw``; columns that a table does not have are missing in its rows.
    """
    return rollups_tagged(base, LEVELS, "Inwoners")


def population_tables(base: DataFrame, ordered: bool = False, store=None) -> dict[str, DataFrame]:
    """The three published tables, sorted by their keys when ``ordered`` (for files).

    Pass ``store=settle`` when more than one is used: all are then counted in one pass and read from there.
    """
    out = rollups(base, LEVELS, "Inwoners", store=store)
    if ordered:
        out = {name: arrange(df, *LEVELS[name]) for name, df in out.items()}
    region = out["Inwoners_regio_leeftijd"].withColumnRenamed("lft_inw", "Leeftijd")
    return {**out, "Inwoners_regio_leeftijd": region}


def municipality_count(historic: DataFrame, provinces: Sequence[str], first_year: int) -> DataFrame:
    """Number of municipalities per year and province, with the row total ``sum``.

    ``historic`` is made distinct before it is counted, so the count needs no per-group sets. A province
    that is not among ``provinces`` fails the job, as the total would lack it.
    """
    seen = (
        historic.where(f"Jaar >= {first_year}").select("Jaar", "Provincie", "gemeente_nr").distinct()
    )
    wide = spread(seen, ["Jaar"], "Provincie", provinces, "count(gemeente_nr)")
    filled = wide.na.fill(0, list(provinces))
    return filled.selectExpr("*", f"{' + '.join(f'`{p}`' for p in provinces)} AS sum")
