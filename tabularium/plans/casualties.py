"""Casualties by region, transport mode, age and sex, from two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, label_map, literal, member, recode
from ..operators import append, attach, group_count, group_sum, left_lookup
from ..sources.scan import tagged
from .dimensions import add_age_labels

BASE = [
    "Jaar",
    "Afloop",
    "Provincie",
    "Gemeente_naam_recent",
    "Gemeente_naam",
    "Vervoerswijze",
    "Geslacht",
    "Leeftijd_stat",
]
OTHER_SEX = "3"


def late_casualties(casualties: DataFrame, objects: DataFrame, year: int) -> DataFrame:
    """Late casualties of one year with the transport mode of their vehicle."""
    modes = objects.select("VORNUM", "KEY_OBJ", "VVM")
    joined = tagged(attach(casualties, modes, ["VORNUM", "KEY_OBJ"]), Jaar=year)
    return joined.selectExpr(
        "Jaar",
        "ERNSTSL AS ernstsl",
        "KEY_GEM AS gemeente_nr",
        "LFTSL AS lftsl",
        "SEXESL AS sexesl",
        "VVM",
    )


def _counted(rows: DataFrame, municipality: str, mode: str) -> DataFrame:
    """Casualties counted on their codes; the age is banded before, as the bands are what is kept."""
    sex = f"CASE WHEN {member('sexesl', [1, 2])} THEN cast(sexesl AS STRING) ELSE {literal(OTHER_SEX)} END"
    coded = add_age_labels(rows, "lftsl").selectExpr(
        "Jaar",
        f"{recode('ernstsl', codes.OUTCOMES)} AS Afloop",
        f"{municipality} AS gemeente_nr",
        f"{mode} AS vvm",
        f"{sex} AS sexesl",
        "Leeftijd_stat",
    )
    return group_count(coded, *coded.columns, name="Aantal")


def _labelled(
    counted: DataFrame, classes: DataFrame, labels: DataFrame, sexes: DataFrame, regions: DataFrame
) -> DataFrame:
    named = left_lookup(counted, classes, "vvm")
    named = left_lookup(named, labels, {"vvm_klasse": "code"})
    named = left_lookup(named, sexes, {"sexesl": "code"})
    return left_lookup(named, regions, "gemeente_nr", unique=False)


def casualty_base(
    new: DataFrame,
    old: DataFrame,
    late: DataFrame | None,
    regions: DataFrame,
    new_modes: DataFrame,
    old_modes: DataFrame,
    mode_labels: DataFrame,
    old_mode_labels: DataFrame,
    sexes: DataFrame,
    cutover: int = codes.CUTOVER_YEAR,
) -> DataFrame:
    """Casualties of both sources counted by outcome, municipality, mode, sex and age.

    ``new`` has ``jaar, ernstsl, key_gem, ote_sl, sexesl, lftsl``; ``old`` and ``late`` have ``Jaar,
    ernstsl, gemeente_nr, VVM, lftsl, sexesl``. The mode tables map a source's code to a class
    (``OTE_ID, VVM_IVO`` and ``VVM, VVMSH``); the label lookups are keyed by text (``code``) and hold
    ``Vervoerswijze``, and ``Geslacht`` for the sexes.
    """

    def classes(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.selectExpr(f"{key} AS vvm", f"cast({value} AS STRING) AS vvm_klasse")

    before = old.where(f"Jaar < {cutover}").select(
        "Jaar", "ernstsl", "gemeente_nr", "VVM", "lftsl", "sexesl"
    )
    if late is not None:
        before = append(before, late)
    before_named = _labelled(
        _counted(before, "gemeente_nr", "VVM"),
        classes(old_modes, "VVM", "VVMSH"),
        old_mode_labels,
        sexes,
        regions,
    ).withColumn("Vervoerswijze", F.expr(label_map("Vervoerswijze", codes.OLD_MODES)))
    after = new.where(f"jaar >= {cutover}").withColumnRenamed("jaar", "Jaar")
    after_named = _labelled(
        _counted(after, "key_gem", "ote_sl"),
        classes(new_modes, "OTE_ID", "VVM_IVO"),
        mode_labels,
        sexes,
        regions,
    )
    return append(*[df.select(*BASE, "Aantal") for df in (before_named, after_named)])


def casualty_tables(base: DataFrame) -> dict[str, DataFrame]:
    """Two tables: casualties per municipality, and per province, mode, age and sex.

    Settle ``base`` when each is written by its own job, or the events are counted twice.
    """
    merged = base.withColumn("Afloop", F.expr(label_map("Afloop", codes.INJURED)))
    return {
        "Gemeente": group_sum(
            merged, "Jaar", "Afloop", "Provincie", "Gemeente_naam_recent", "Gemeente_naam", measure="Aantal"
        ),
        "Vervoerswijze": group_sum(
            base.withColumnRenamed("Leeftijd_stat", "Leeftijd"),
            "Jaar",
            "Afloop",
            "Provincie",
            "Vervoerswijze",
            "Leeftijd",
            "Geslacht",
            measure="Aantal",
        ),
    }
