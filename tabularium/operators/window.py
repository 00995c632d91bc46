"""Running totals, and packing whole years into chunks of limited size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST_YEAR = 9999


def only_years(counts: DataFrame, year: str) -> DataFrame:
    """``counts`` itself, but the job fails on a year that is no calendar year (0 to 9999, or missing).

    This bounds the rows of a table with one row per year, whatever the size of the table that was
    counted, and drops none.
    """
    valid = f"`{year}` IS NULL OR cast(`{year}` AS BIGINT) BETWEEN 0 AND {LAST_YEAR}"
    return counts.where(f"assert_true({valid}, 'not a calendar year') IS NULL")


def running_total(
    counts: DataFrame, year: str = "Jaar", measure: str = "n", name: str = "cum"
) -> DataFrame:
    """Running total over the years, newest first.

    ``counts`` holds one row per calendar year, so the unpartitioned window sees a few thousand rows
    whatever the size of the table that was counted. The job fails on what is no calendar year.
    """
    newest_first = f"(ORDER BY `{year}` DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return only_years(counts, year).selectExpr("*", f"sum(`{measure}`) OVER {newest_first} AS `{name}`")


def pack_years(
    counts: DataFrame,
    year: str = "Jaar",
    measure: str = "n",
    limit: int = 1_048_575,
    name: str = "serie",
) -> DataFrame:
    """Give every year a chunk number so that chunks stay within ``limit``, newest years first.

    A chunk is closed when the next year would take it over the limit; a year that is above the limit
    by itself gets its own chunk. ``counts`` must hold one row per year. All years are folded in one
    row, which is why the job fails on what is no calendar year.
    """
    newest_first = f"sort_array(collect_list(struct({year} AS y, cast({measure} AS BIGINT) AS n)), false)"
    entries = "array<struct<y:bigint,n:bigint,cum:bigint,chunk:int>>"
    full = f"acc.size > 0 AND acc.size + row.n > {limit}"
    chunk = f"acc.chunk + if({full}, 1, 0)"
    entry = f"struct(cast(row.y AS BIGINT) AS y, row.n AS n, acc.cum + row.n AS cum, {chunk} AS chunk)"
    step = (
        f"struct(if({full}, row.n, acc.size + row.n) AS size, {chunk} AS chunk, acc.cum + row.n AS cum,"
        f" concat(acc.out, array({entry})) AS out)"
    )
    start = f"struct(0L AS size, 1 AS chunk, 0L AS cum, cast(array() AS {entries}) AS out)"
    packed = (
        only_years(counts, year)
        .agg(F.expr(f"{newest_first} AS years"))
        .selectExpr(f"inline(aggregate(years, {start}, (acc, row) -> {step}).out)")
    )
    kind = counts.schema[year].dataType.simpleString()
    return packed.selectExpr(
        f"cast(y AS {kind}) AS {year}", f"n AS {measure}", "cum", f"chunk AS {name}"
    )
