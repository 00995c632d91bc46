"""Road deaths by age class and transport mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import codes, label_map
from ..operators import arrange, left_lookup


def deaths_by_class(
    deaths: DataFrame, age_classes: DataFrame, modes: DataFrame, ordered: bool = True
) -> DataFrame:
    """Positive counts of deaths with their labels.

    ``deaths`` has ``JAAR, LEEFTIJD_4_75, VERVOER2, DOOD``; the lookups translate ``code`` to
    ``Leeftijdsklasse``, and to ``Vervoerswijze`` with ``TransportMode``.
    """
    rows = deaths.where("DOOD > 0").selectExpr(
        "JAAR AS Jaar", "LEEFTIJD_4_75", "VERVOER2", "DOOD AS Verkeersdoden"
    )
    words = label_map("replace(Leeftijdsklasse, '-', ' t/m ')", codes.DEATH_AGE_REPAIRS)
    spelled = age_classes.selectExpr("code", f"{words} AS Leeftijdsklasse")
    named = left_lookup(rows, spelled, {"LEEFTIJD_4_75": "code"})
    named = left_lookup(named, modes, {"VERVOER2": "code"})
    if ordered:
        named = arrange(named, "Jaar", "Leeftijdsklasse", "VERVOER2")
    return named.select("Jaar", "Leeftijdsklasse", "Vervoerswijze", "TransportMode", "Verkeersdoden")
