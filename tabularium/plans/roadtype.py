"""Deaths and accidents by road type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..operators import attach, group_count, reshape_wide, wide_count
from ..operators.aggregate import total


DEATHS, FATAL = "ernstsl BETWEEN 0 AND 5", "ernong5 = 1"  # fixed values: outcomes of a casualty and of an accident


def road_type_wide(
    categories: DataFrame, years: Sequence[int], road_type: str = "wegtype", deaths: str = "n_slacht_dood"
) -> dict[str, DataFrame]:
    """Deaths and fatal accidents per road type, one column per year.

    ``categories`` holds one row per accident with ``jaar``, ``ernong5``, the road type and the deaths.
    Accidents are counted once, per road type and year; both tables are laid out from that.
    """
    rows = categories.where(f"jaar IN {literals(years)} AND {FATAL}")
    measures = {"doden": total(deaths), "ongevallen": "count(1)"}
    counted = rows.groupBy(road_type, "jaar").agg(*[F.expr(f"{e} AS {name}") for name, e in measures.items()])
    return {
        name: reshape_wide(counted.select(road_type, "jaar", name), "jaar", name, years) for name in measures
    }


def casualties_by_road_type(
    casualties: DataFrame,
    categories: DataFrame,
    years: Sequence[int],
    road_type: str = "wegtype",
    prefix: str = "",
) -> DataFrame:
    """Deaths per road type of their accident, one column per year.

    ``casualties`` has ``jaar``, ``vornum`` and the outcome ``ernstsl``. Deaths are counted per accident before the join, so both sides meet with one row per accident
    and year, and the join finds its left side shuffled on the keys already. The accident key is the
    primary key of ``categories``, so it is unique and never missing there: a plain comparison will do.
    """
    keys = ["jaar", "vornum"]
    died = casualties.where(f"jaar IN {literals(years)} AND {DEATHS}")
    per_accident = group_count(died, *keys, name="slachtoffers")
    typed = attach(per_accident, categories.select(*keys, road_type), keys, null_safe=False)
    return wide_count(typed, road_type, period="jaar", periods=years, weight="slachtoffers", prefix=prefix)


def deaths_by_road(
    casualties: DataFrame,
    categories: DataFrame,
    year: int,
    by: Sequence[str],
    across: str,
    values: Sequence,
    where: str = "true",
    road_type: str = "wegtype",
    prefix: str = "",
) -> DataFrame:
    """Deaths of one year with the road type of their accident, counted by ``by`` with one column per value of ``across``.

    ``by=[road_type, "wegbeh"], across="maxsne"`` lays speed limits side by side, ``by=["loctypon"], across="wegbeh"``
    road authorities. ``where`` is a test on casualties and the road type. A value that is not among ``values`` fails the
    job; a missing one has the column ``null``, if ``values`` holds it. Deaths are counted per accident and code first, so the
    join meets one row for each.
    """
    keys = ["jaar", "vornum"]
    codes = [c for c in dict.fromkeys([*by, across, "loctypon", "maxsne", "wegbeh", "bebouw"]) if c != road_type]
    died = casualties.where(f"jaar = {int(year)} AND {DEATHS}")
    per_accident = group_count(died, *keys, *codes, name="doden")
    typed = attach(per_accident, categories.select(*keys, road_type), keys, null_safe=False).where(where)
    return wide_count(typed, *by, period=across, periods=values, weight="doden", prefix=prefix)


def location_study(casualties: DataFrame, year: int, speed: int) -> DataFrame:
    """Fatal accidents and deaths per location type, for one year and speed limit."""
    rows = casualties.where(f"jaar = {year} AND maxsne = {speed} AND {DEATHS}")
    per_accident = group_count(rows, "vornum", "loctypon", name="ndood")
    return per_accident.groupBy("loctypon").agg(
        F.expr("count(1) AS ongevallen"), F.expr("sum(ndood) AS doden")
    )
