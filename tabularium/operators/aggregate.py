"""Counts, sums, contingency tables, wide tables and reconciliation.

Everything here is an aggregate with a map-side part, so a group that holds a third of all rows
reaches its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING, literal
from .union import append


def group_count(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    """Rows per group."""
    return df.groupBy(*by).agg(F.expr(f"count(1) AS `{name}`"))


def total(measure: str) -> str:
    """Sum that skips missing values and is 0, not missing, when there is nothing to add."""
    return f"coalesce(sum({measure}), 0L)"


def group_sum(df: DataFrame, *by: str | Column, measure: str, name: str | None = None) -> DataFrame:
    """Sum of a measure per group, see :func:`total`."""
    return df.groupBy(*by).agg(F.expr(f"{total(measure)} AS `{name or measure}`"))


def weighted_count(df: DataFrame, *by: str | Column, weight: str | None = None, name: str = "n") -> DataFrame:
    """Rows per group, or the sum of ``weight`` per group when given."""
    return group_count(df, *by, name=name) if weight is None else group_sum(df, *by, measure=weight, name=name)


def listed(column: str, values: Sequence[Any] | None) -> str:
    """The column itself, but the job fails on a value that is not among ``values`` (None: any value)."""
    if values is None:
        return f"`{column}`"
    known = " OR ".join(f"`{column}` <=> {literal(v)}" for v in values) or "false"
    message = f"concat({literal(f'value of {column} without a column: ')}, coalesce(cast(`{column}` AS STRING), 'missing'))"
    return f"CASE WHEN {known} THEN `{column}` ELSE raise_error({message}) END"


def spread(df: DataFrame, by: Sequence[str], column: str, values: Sequence[Any] | None, cell: str) -> DataFrame:
    """Pivot with one column per value. Given values fix the columns; any other value fails the job."""
    rest = [f"`{c}`" for c in df.columns if c != column]
    checked = df.selectExpr(*rest, f"{listed(column, values)} AS `{column}`")
    return checked.groupBy(*by).pivot(column, values and list(values)).agg(F.expr(cell))


def contingency(
    df: DataFrame,
    rows: str,
    columns: str,
    levels: Sequence[Any] | None = None,
    missing_level: bool = False,
) -> DataFrame:
    """Counts of two variables against each other, zero where a combination does not occur.

    Missing values are left out, or form a level called ``NA`` when ``missing_level``. ``levels`` fixes
    the columns and their order and saves the job that looks them up; a value that is not among them
    fails the job.
    """
    if missing_level:
        if levels is not None:
            levels = [str(v) for v in levels] + [MISSING]
        pairs = df.selectExpr(
            *[f"coalesce(cast(`{c}` AS STRING), {literal(MISSING)}) AS `{c}`" for c in (rows, columns)]
        )
    else:
        pairs = df.where(f"`{rows}` IS NOT NULL AND `{columns}` IS NOT NULL").select(rows, columns)
    counted = spread(pairs, [rows], columns, levels, "count(1)")
    return counted.na.fill(0, counted.columns[1:])


def wide_count(
    df: DataFrame,
    *by: str,
    period: str,
    periods: Sequence[Any] | None = None,
    weight: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """One column per period with the (weighted) count; an absent cell is missing, not zero.

    ``periods`` fixes the columns and their order and saves the job that looks them up; a period that
    is not among them fails the job.
    """
    measure = "count(1)" if weight is None else total(weight)
    wide = spread(df, by, period, periods, measure)
    return wide.withColumnsRenamed({c: f"{prefix}{c}" for c in wide.columns[len(by) :]})


def reshape_wide(
    df: DataFrame,
    names_from: str,
    values_from: str,
    periods: Sequence[Any] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Spread one column over period columns; all other columns identify the row.

    The job fails when a cell would have to hold two values, or a value is not among ``periods``.
    """
    ids = [c for c in df.columns if c not in (names_from, values_from)]
    message = literal(f"two values of {values_from} for one cell")
    cell = f"CASE WHEN count(1) <= 1 THEN any_value(`{values_from}`) ELSE raise_error({message}) END"
    wide = spread(df, ids, names_from, periods, cell)
    return wide.withColumnsRenamed({c: f"{prefix}{c}" for c in wide.columns[len(ids) :]})


def rollups_tagged(
    base: DataFrame, levels: Mapping[str, Sequence[str]], measure: str, name: str | None = None, tag: str = "tabel"
) -> DataFrame:
    """Coarser totals of one counted table, all levels in one pass and one table.

    ``levels`` names lists of columns; a row carries the name of its level in ``tag``, and columns that its level does not
    have are missing. One aggregate over grouping sets: a key that is missing in the data and one that was rolled up
    are told apart by ``grouping_id``, so levels never mix. Two levels of the same columns are one set with two names.
    """
    columns = list(dict.fromkeys(c for by in levels.values() for c in by))
    sets = {tuple(c for c in columns if c in by): None for by in levels.values()}
    # the bit of a column, first one highest, is set where a set rolls it up
    number = {some: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in some) for some in sets}
    names: dict[int, list[str]] = {}
    for level, by in levels.items():
        names.setdefault(number[tuple(c for c in columns if c in by)], []).append(level)
    grouped = base.groupingSets([[F.col(f"`{c}`") for c in some] for some in sets], *[F.col(f"`{c}`") for c in columns])
    out = grouped.agg(F.expr(f"{total(measure)} AS `{name or measure}`"), F.expr("grouping_id() AS _set"))
    level = " ".join(f"WHEN {n} THEN array({', '.join(map(literal, some))})" for n, some in names.items())
    keys = [f"`{c}`" for c in columns]
    return out.selectExpr(f"explode(CASE _set {level} END) AS `{tag}`", *keys, f"`{name or measure}`")


def rollups(
    base: DataFrame, levels: Mapping[str, Sequence[str]], measure: str, name: str | None = None, store=None
) -> dict[str, DataFrame]:
    """Coarser totals of one counted table, one per named list of columns.

    ``store`` (for one, ``settle``) writes the totals of all levels in one pass, see :func:`rollups_tagged`; the tables
    are then read from there. Without it each table is an aggregate of ``base`` by itself, for when one of them is used.
    """
    if store is None:
        return {level: group_sum(base, *by, measure=measure, name=name or measure) for level, by in levels.items()}
    stored = store(rollups_tagged(base, levels, measure, name, "_level"), "rollups")
    return {
        level: stored.where(F.col("_level") == level).select(*by, name or measure) for level, by in levels.items()
    }


def reconcile(breakdowns: Mapping[str, DataFrame], year: str, measure: str) -> DataFrame:
    """Yearly totals of one measure over several breakdowns, side by side, with ``all_equal``.

    A breakdown without rows for a year shows a missing total, and then the totals are not equal.
    """
    rows = [
        df.selectExpr(year, f"{measure} AS n", f"{literal(dim)} AS _dim") for dim, df in breakdowns.items()
    ]
    names = list(breakdowns)
    wide = append(*rows).groupBy(year).pivot("_dim", names).agg(F.expr(total("n")))
    same = " AND ".join(f"`{n}` <=> `{names[0]}`" for n in names)
    return wide.selectExpr("*", f"{same} AND `{names[0]}` IS NOT NULL AS all_equal")


def reconcile_measures(
    breakdowns: Mapping[str, DataFrame], year: str, measures: Sequence[str], name: str = "maat"
) -> DataFrame:
    """:func:`reconcile` for several measures at once, named in a column; every breakdown is read once."""
    rows = [
        df.groupBy(year).agg(*[F.expr(f"{total(m)} AS `{m}`") for m in measures]).withColumn("_dim", F.lit(dim))
        for dim, df in breakdowns.items()
    ]
    cells = ", ".join(f"struct({literal(m)} AS `{name}`, cast(`{m}` AS DOUBLE) AS n)" for m in measures)
    long = append(*rows).selectExpr(year, "_dim", f"inline(array({cells}))")
    names = list(breakdowns)
    wide = long.groupBy(name, year).pivot("_dim", names).agg(F.expr("sum(n)"))
    same = " AND ".join(f"`{n}` <=> `{names[0]}`" for n in names)
    return wide.selectExpr("*", f"{same} AND `{names[0]}` IS NOT NULL AS all_equal")


def same_total(output: DataFrame, measure: str, *inputs: DataFrame) -> DataFrame:
    """Whether the measure adds up to the number of input rows: one row ``(total, rows, equal)``."""
    out = output.agg(F.expr(f"cast({total(measure)} AS BIGINT) AS total"), F.expr("0L AS rows"))
    counts = [df.agg(F.expr("0L AS total"), F.expr("count(1) AS rows")) for df in inputs]
    both = reduce(DataFrame.unionAll, counts, out).agg(
        F.expr("sum(total) AS total"), F.expr("sum(rows) AS rows")
    )
    return both.selectExpr("*", "total = rows AS equal")


def last_values(values: Sequence[str], order: Sequence[str]) -> str:
    """Aggregate that gives a struct of the values in the last row.

    A missing first key of ``order`` counts as last; the other keys break ties.
    """
    return f"max_by(struct({', '.join(values)}), struct({order[0]} IS NULL, {', '.join(order)}))"


def last_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Values of the last row of each group, missing values included.

    ``order`` is the time column followed by tie-breaks; a row without a time counts as last. Done as
    a ``max_by`` aggregate rather than a ranked window, which would carry whole groups to one task.
    """
    picked = df.groupBy(*by).agg(F.expr(f"{last_values(values, order)} AS _last"))
    return picked.select(*by, "_last.*")
