"""Which tables exist and which columns they have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literal


def table_list(
    spark: SparkSession,
    databases: list[str] | None = None,
    containing: str | None = None,
) -> DataFrame:
    """``(tabelnaam, schema, dmx_naam)`` of all tables but temporary views, ``dmx_naam`` being the name in capitals.

    The list is catalogue metadata, one row per table, not table data.
    """
    rows = []
    for db in databases or [spark.catalog.currentDatabase()]:
        rows += [(t.name, db) for t in spark.catalog.listTables(db) if not t.isTemporary]
    df = spark.createDataFrame(rows, "tabelnaam string, schema string")
    df = df.selectExpr("*", "upper(tabelnaam) AS dmx_naam")
    return df if containing is None else df.where(f"contains(tabelnaam, {literal(containing)})")


def column_list(df: DataFrame) -> list[str]:
    """Column names in capitals, the form in which names are compared."""
    return [c.upper() for c in df.columns]


def column_table(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(tabelnaam, kolom, plaats)``: the columns of every table, names as stored, places from 1.

    Metadata only; no table is read.
    """
    rows = [(name, c, i) for name, df in tables.items() for i, c in enumerate(df.columns, 1)]
    return spark.createDataFrame(rows, "tabelnaam string, kolom string, plaats int")


def catalog_columns(spark: SparkSession, databases: Sequence[str], containing: str | None = None) -> DataFrame:
    """:func:`column_table` of all tables of the databases, of those whose name contains a text."""
    listed = table_list(spark, list(databases), containing).collect()  # metadata only
    parts = [
        column_table(spark, {r.tabelnaam: spark.table(f"`{r.schema}`.`{r.tabelnaam}`")}).withColumn("schema", F.lit(r.schema))
        for r in listed
    ]
    empty = column_table(spark, {}).withColumn("schema", F.lit(""))
    return reduce(DataFrame.unionByName, parts, empty)
