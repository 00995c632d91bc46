"""Table profile: size and period of every table."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, first_match, literal, literals
from ..sources import FOOTERS, column_list, footer_scan, scan, settings, settle, table_list

# pairs of columns that bound a period, tried in this order when there is no year column
PERIOD_COLUMNS = [("BEGDAT", "ENDDAT"), ("WVK_BEGDAT", "WVK_EINDDAT")]
ROW_ID = "ROWID"
YEAR = "JAAR"
UNREADABLE = (PySparkException, Py4JJavaError)  # in the plan, and in a task
MEASURES = {"rijen": "BIGINT", "kolommen": "INT", "minY": "INT", "maxY": "INT"}


def period_columns(columns: Collection[str]) -> tuple[str, str]:
    """First and last year as aggregates over whichever year or date columns the table has."""
    if YEAR in columns:
        return f"cast(min({YEAR}) AS INT)", f"cast(max({YEAR}) AS INT)"
    for begin, end in PERIOD_COLUMNS:
        if begin in columns and end in columns:
            # greatest() skips a column without any date
            last = f"greatest(max(cast({begin} AS DATE)), max(cast({end} AS DATE)))"
            return f"year(min(cast({begin} AS DATE)))", f"year({last})"
    return "cast(NULL AS INT)", "cast(NULL AS INT)"


def profile_table(schema: str, name: str, df: DataFrame | None) -> DataFrame:
    """One aggregate over one scan: rows, columns, first and last year.

    Without a table the row shows missing values.
    """
    head = [f"{literal(schema)} AS schema", f"{literal(name.upper())} AS dmx_naam"]
    if df is None:
        empty = [f"cast(NULL AS {kind}) AS {c}" for c, kind in MEASURES.items()]
        return SparkSession.active().range(1).selectExpr(*head, *empty)
    columns = column_list(df)
    first, last = period_columns(columns)
    width = len([c for c in columns if c != ROW_ID])
    measures = ["count(1) AS rijen", f"{width} AS kolommen", f"{first} AS minY", f"{last} AS maxY"]
    return df.agg(*[F.expr(e) for e in [*head, *measures]])


def profiled(name: str) -> bool:
    """Whether a table can be profiled; some risk tables and copies cannot."""
    return name.upper() not in codes.UNPROFILED


def correct_periods(profile: DataFrame) -> DataFrame:
    """Known periods of single tables, and first years where a target year would stand."""
    fixed_first = [(f"dmx_naam = {literal(t)}", years[0]) for t, years in codes.FIXED_PERIODS.items()]
    fixed_last = [(f"dmx_naam = {literal(t)}", years[1]) for t, years in codes.FIXED_PERIODS.items()]
    targets = [
        (f"dmx_naam = {literal(t)} AND minY = {codes.TARGET_YEAR}", year)
        for t, year in codes.TARGET_FIRST_YEARS.items()
    ]
    return profile.selectExpr(
        "schema",
        "dmx_naam",
        "rijen",
        "kolommen",
        f"{first_match(fixed_first + targets, 'minY')} AS minY",
        f"{first_match(fixed_last, 'maxY')} AS maxY",
    )


def profile_tables(tables: Mapping[tuple[str, str], DataFrame | None]) -> DataFrame:
    """One row per ``(schema, name)``.

    All aggregates are branches of one union, so they run as one job and their scans side by side.
    """
    rows = [
        profile_table(schema, name, df if profiled(name) else None) for (schema, name), df in tables.items()
    ]
    return correct_periods(reduce(DataFrame.unionByName, rows))


def _settled(spark: SparkSession, tables: Mapping[tuple[str, str], DataFrame | None]) -> DataFrame:
    """The profile, run and stored where aggregates may be answered by the source."""
    with settings(spark, FOOTERS):
        out = settle(profile_tables(tables), "profile")
    # a count out of footers is a sum over row groups, and missing where there is none
    known = literals(["", *[name.upper() for (_, name), df in tables.items() if df is not None]])
    return out.withColumn("rijen", F.expr(f"CASE WHEN rijen IS NULL AND dmx_naam IN {known} THEN 0L ELSE rijen END"))


def profile_stored(spark: SparkSession, paths: Mapping[tuple[str, str], str]) -> DataFrame:
    """One row per ``(schema, name)`` of parquet tables whose measures are stored columns, taken from file footers.

    A profile asks for a row count and for the ends of a year or date column, which the footers hold: the scan opens
    footers and reads no column (``PushedAggregation`` in its plan). A column kept as a timestamp has no usable ends there,
    and is read as :func:`profile_tables` would. Settled, as the pushing down is decided when the job starts.
    """

    def run(some: Mapping[tuple[str, str], str], read) -> DataFrame:
        return _settled(spark, {key: read(spark, path) if profiled(key[1]) else None for key, path in some.items()})

    try:
        return run(paths, footer_scan)
    except UNREADABLE:
        # a file in which a column is missing throughout has no ends in its footer, and Spark then refuses
        parts = []
        for key, path in paths.items():
            try:
                parts.append(run({key: path}, footer_scan))
            except UNREADABLE:
                parts.append(run({key: path}, scan))
        return reduce(DataFrame.unionByName, parts)


def footer_table(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalogue table read by :func:`footer_scan`, where it is a parquet table whose files have its columns.

    None for views, other formats and partitioned tables (their year column may stand in no file).
    """
    said = {r.col_name.strip(): (r.data_type or "").strip() for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if said.get("Provider", "").lower() != "parquet" or not said.get("Location") or "# Partition Information" in said:
        return None
    files = footer_scan(spark, said["Location"])
    return files if column_list(files) == column_list(spark.table(name)) else None


def profile_catalog(spark: SparkSession, databases: Sequence[str], batch: int = 50) -> DataFrame:
    """Profile of all tables of the databases, ``batch`` tables per job, with an ``error`` column.

    Parquet tables are profiled from their footers, see :func:`profile_stored`. Each batch is settled, so that no plan
    grows without bound. When a batch fails, its tables are profiled one by one, without footers if need be: a table
    that cannot be read shows missing values and the first line of its error.
    """
    names = [(r.schema, r.tabelnaam) for r in table_list(spark, list(databases)).collect()]  # metadata only
    good = "cast(NULL AS STRING) AS error"

    def run(part: Sequence[tuple[str, str]], footers: bool) -> DataFrame:
        tables = {}
        for db, name in part:
            full = f"`{db}`.`{name}`"
            df = footer_table(spark, full) if footers and profiled(name) else None
            tables[db, name] = (spark.table(full) if df is None else df) if profiled(name) else None
        return _settled(spark, tables).selectExpr("*", good)

    parts = []
    for start in range(0, len(names), batch):
        part = names[start : start + batch]
        try:
            parts.append(run(part, footers=True))
        except UNREADABLE:
            for single in part:
                try:
                    try:
                        parts.append(run([single], footers=True))
                    except UNREADABLE:
                        parts.append(run([single], footers=False))
                except UNREADABLE as failure:
                    empty = correct_periods(profile_table(*single, None))
                    said = literal(str(failure).splitlines()[0][:200])
                    parts.append(empty.selectExpr("*", f"{said} AS error"))
    if not parts:
        return profile_table("", "", None).selectExpr("*", good).limit(0)
    return reduce(DataFrame.unionByName, parts)
