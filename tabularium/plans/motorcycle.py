"""Cases for the motorcycle study: casualties of accidents with motorcycles in chosen towns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import codes, first_match, literal, literals, recode, strict_if
from ..operators import attach, keep_keys
from ..sources import year_bounds

JOIN_KEYS = ["jaar", "vornum", "wegbeh", "loctypon", "bebouw", "maxsne", "key_gem"]
OUTPUT = [
    "jaar",
    "vornum",
    "wegbeh",
    "bebouw",
    "maxsne",
    "sexesl",
    "lftsl",
    "datum",
    "N_motor",
    "gme_naam",
    "ernst",
    "locatietype",
    "vvm",
    "tegenp",
    "wvd",
]


def motorcycle_cases(
    casualties: DataFrame,
    accidents: DataFrame,
    province: str = codes.STUDY_PROVINCE,
    towns: Sequence[str] = codes.STUDY_TOWNS,
    extra_accidents: Sequence[str] = codes.STUDY_EXTRA_ACCIDENTS,
    first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """One row per casualty, with recoded columns.

    ``accidents`` has the join keys and ``ernong5, datum, N_motor, vervoersw_detail_A,
    vervoersw_detail_B, gme_naam, pve_naam``; ``casualties`` has the join keys and ``ernstsl, ote_sl,
    botspartner, vervoersw_detail, tegenpartij_detail, sexesl, lftsl, func``. Accident keys are text on
    both sides. Accidents with damage only are left out. ``extra_accidents`` are taken in although no
    motorcycle was coded. ``first_year`` and ``last_year`` bound the scans of both tables.
    """
    years = year_bounds("jaar", first_year, last_year)
    accidents, casualties = accidents.where(years), casualties.where(years)
    motor = literals(codes.MOTOR_CODES)
    involved = f"N_motor > 0 OR vervoersw_detail_A IN {motor} OR vervoersw_detail_B IN {motor}"
    if extra_accidents:
        involved += f" OR vornum IN {literals(extra_accidents)}"
    chosen = (
        accidents.where(f"ernong5 < {codes.DAMAGE_ONLY}")
        .where(f"pve_naam = {literal(province)} AND gme_naam IN {literals(towns)}")
        .where(involved)
        .select(*JOIN_KEYS, "ernong5", "datum", "N_motor", "gme_naam")
    )
    # towns are compared before the wide join, which then only sees casualties of those towns; there are
    # fewer towns than municipalities in the country, so their keys travel instead of the casualties
    local = keep_keys(casualties, chosen, "key_gem", bounded=True)
    joined = attach(local, chosen, JOIN_KEYS).where(
        f"ernong5 IS NOT NULL OR ote_sl IN {motor} OR botspartner IN {motor}"
        f" OR vervoersw_detail IN {motor} OR tegenpartij_detail IN {motor}"
    )

    def party(detail: str, party_code: str, classes) -> str:
        return f"coalesce({recode(detail, codes.STUDY_MOTORS)}, {recode(party_code, classes)})"

    recoded = {
        "ernst": recode("ernstsl", codes.STUDY_OUTCOMES),
        "locatietype": recode("loctypon", codes.STUDY_LOCATIONS),
        "vvm": party("vervoersw_detail", "ote_sl", codes.STUDY_MODES),
        "tegenp": party("tegenpartij_detail", "botspartner", codes.STUDY_OPPONENTS),
        "N_motor": strict_if("N_motor = 0", "1", "N_motor"),
    }
    rider = f"{recoded['vvm']} IN {literals(label for _, label in codes.STUDY_MOTORS)}"
    recoded["wvd"] = first_match(
        [(f"{rider} AND func = 1", "bestuurder"), (f"{rider} AND func = 2", "passagier")], literal("nvt")
    )
    return joined.selectExpr(*[f"{recoded[c]} AS {c}" if c in recoded else c for c in OUTPUT])
