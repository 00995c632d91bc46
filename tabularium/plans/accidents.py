"""Accidents by region, road authority and severity, from two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, first_match, label_map, literal, literals, strict_if
from ..operators import append, append_filled, group_count, group_sum, left_lookup
from .dimensions import REGION_COLUMNS

COLUMNS = ["Jaar", "Ernst_ongeval", "pv", *REGION_COLUMNS, "Wegbeheerder"]


def late_accidents(*files: DataFrame) -> DataFrame:
    """Late reports with their two-digit years spelled out."""
    rows = append(*[f.select("JAAR", "KEY_GEM", "WEGBEH", "NDOOD") for f in files])
    return rows.selectExpr(
        f"{strict_if('JAAR = 92', '1992', '1993')} AS Jaar",
        "KEY_GEM AS gemeente_nr",
        "WEGBEH AS wegbeh",
        "NDOOD AS Ndood",
    )


def _new_codes(new: DataFrame) -> DataFrame:
    severity = first_match(
        [("ernong5 = 1", "Dodelijk"), (f"ernong5 = {codes.DAMAGE_ONLY}", "UMS")], literal("Letsel")
    )
    reported = first_match(
        [
            (f"PVrapp IN {literals(codes.REPORT_FULL_CODES)}", codes.REPORT_FULL),
            (f"ernong5 <> {codes.DAMAGE_ONLY}", codes.REPORT_FULL),
            (f"PVrapp IN {literals(codes.REPORT_SHORT_CODES)}", codes.REPORT_SHORT),
            (f"PVrapp IN {literals(codes.REPORT_INSURER_CODES)}", codes.REPORT_INSURER),
        ]
    )
    return new.selectExpr(
        "jaar AS Jaar",
        f"{severity} AS Ernst_ongeval",
        f"{reported} AS pv",
        "key_gem AS gemeente_nr",
        "cast(wegbeh AS STRING) AS wegbeh",
    )


def _old_codes(old: DataFrame) -> DataFrame:
    return old.selectExpr(
        "Jaar",
        f"{first_match([('Ndood = 0', 'Letsel')], literal('Dodelijk'))} AS Ernst_ongeval",
        f"{literal(codes.REPORT_FULL)} AS pv",
        "gemeente_nr",
        "cast(wegbeh AS STRING) AS wegbeh",
    )


def _labelled(coded: DataFrame, regions: DataFrame, authorities: DataFrame, old: bool) -> DataFrame:
    counted = group_count(coded, *coded.columns, name="Aantal")
    named = left_lookup(counted, authorities, {"wegbeh": "code"})
    named = left_lookup(named, regions, "gemeente_nr", unique=False)
    if old:
        named = named.withColumn("Wegbeheerder", F.expr(label_map("Wegbeheerder", codes.OLD_AUTHORITIES)))
    return group_sum(named, *COLUMNS, measure="Aantal")


def accident_series(
    new: DataFrame,
    old: DataFrame,
    late: DataFrame | None,
    regions: DataFrame,
    authorities: DataFrame,
    cutover: int = codes.CUTOVER_YEAR,
) -> DataFrame:
    """Number of accidents per year, severity, report type, region and authority.

    ``new`` has ``jaar, ernong5, PVrapp, key_gem, wegbeh``; ``old`` and ``late`` have ``Jaar, Ndood,
    gemeente_nr, wegbeh``; ``authorities`` translates the code as text to ``Wegbeheerder``. Events are
    counted on their codes, and only the counts meet the lookups.
    """
    before = _old_codes(old.where(f"Jaar < {cutover}"))
    if late is not None:
        before = append(before, _old_codes(late))
    after = _new_codes(new.where(f"jaar >= {cutover}"))
    return append_filled(
        _labelled(before, regions, authorities, old=True),
        _labelled(after, regions, authorities, old=False),
    )
