"""Dimensions shared by the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import band, codes
from ..operators import arrange, codebook_lookup, left_lookup, successors

REGION_COLUMNS = [
    "gemeente_nr_recent",
    "Gemeente_naam_recent",
    "Gemeente_naam",
    "Provincie",
    "Politieregio",
    "Eenheid",
]


def variable_lookup(codebook: DataFrame, variable: str) -> DataFrame:
    """The lookup of one of the known codebook variables (``codes.VARIABLES``), keyed by ``code``."""
    number, name, label, label_en, numeric, repairs = codes.VARIABLES[variable]
    return codebook_lookup(codebook, number, name, label, label_en, numeric, repairs)


def region_dimension(
    municipalities: DataFrame,
    provinces: DataFrame,
    police_regions: DataFrame,
    police_units: DataFrame,
) -> DataFrame:
    """Any municipality of the past to its present one and the present one's regions.

    ``municipalities`` has ``gemeente_nr, Gemeente_naam, gemeente_nr_recent, provincie, politie_regio,
    eenheid``; the lookups translate the last three (``code``) to ``Provincie``, ``Politieregio`` and
    ``Eenheid``. The regions of a municipality that no longer exists are not used. Settle the result when
    several plans use it: its size is known then, and so is whether it can be broadcast.
    """
    areas = municipalities.select(
        "gemeente_nr", "Gemeente_naam", "gemeente_nr_recent", "provincie", "politie_regio", "eenheid"
    ).withColumnsRenamed({"provincie": "prov_nr", "politie_regio": "regio_nr", "eenheid": "eenheid_nr"})
    dim = successors(areas, "gemeente_nr", "gemeente_nr_recent")
    dim = left_lookup(dim, provinces, {"prov_nr": "code"})
    dim = left_lookup(dim, police_regions, {"regio_nr": "code"})
    dim = left_lookup(dim, police_units, {"eenheid_nr": "code"})
    return dim.select("gemeente_nr", *REGION_COLUMNS)


def mode_groups(modes: DataFrame) -> DataFrame:
    """Main group, code and label of every transport mode, by group number and code.

    ``modes`` has ``cob_code, cob_label, hoofdgroep, hoofdgroep_code``.
    """
    named = modes.withColumnsRenamed({"cob_code": "code", "cob_label": "oms"})
    return arrange(named, "hoofdgroep_code", "code").select("hoofdgroep", "code", "oms")


def add_age_labels(df: DataFrame, age: str) -> DataFrame:
    """Fine and statistical age band; unknown ages get a label, ages outside all bands their number."""
    special = {codes.AGE_UNKNOWN: codes.UNKNOWN}
    number = f"cast({age} AS STRING)"
    fine = band(age, codes.AGE_BANDS, special, number)
    statistical = band(age, codes.AGE_BANDS_STATISTICAL, special, number)
    return df.selectExpr("*", f"{fine} AS Leeftijd", f"{statistical} AS Leeftijd_stat")
