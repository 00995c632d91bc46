"""Table profile, deliveries and the data overview."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import left_lookup
from ..plans import (
    data_overview,
    delivery_summary,
    listed_tables,
    profile_catalog,
    profile_tables,
    system_tables,
    table_registry,
)
from ..sources import settle, shared_dir, table_list
from . import standins
from .base import checked, table
from .basics import visible_sql


@checked(
    "delivery_summary",
    f"""
    WITH d AS (SELECT * FROM ({standins.DELIVERIES.sql}) WHERE prod_nr IS NOT NULL),
    l AS (SELECT *, row_number() OVER (PARTITION BY prod_nr ORDER BY lever_datum DESC NULLS FIRST, lever_nr DESC) AS rn FROM d),
    g AS (SELECT prod_nr, min(lever_datum) AS eerste, max(lever_datum) AS laatste, min(lever_periode) AS a, max(lever_periode) AS b,
                 max(lever_IB_klasse) AS klasse, max(lever_IB_opvolging) AS opvolging, count(*) AS n FROM d GROUP BY prod_nr)
    SELECT g.prod_nr, CAST(g.eerste AS VARCHAR) AS EersteLevering, CAST(g.laatste AS VARCHAR) AS LaatsteLevering,
           l.lever_omschrijving, l.lever_archief, l.lever_voorwaarde, l.lever_bewaartermijn,
           g.klasse AS lever_IBklasse, g.opvolging AS lever_IBopvolging, g.n AS lever_aantal,
           CASE WHEN g.a IS NOT NULL THEN CAST(g.a AS VARCHAR) || ' tm ' || CAST(g.b AS VARCHAR) END AS lever_perioden
    FROM g JOIN l ON l.prod_nr = g.prod_nr AND l.rn = 1
    """,
)
def delivery_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = delivery_summary(standins.DELIVERIES.read(spark, sf_dir), tie_break=["lever_nr"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("EersteLevering", "LaatsteLevering")})


# table: schema, name in the profile, columns added to show every way a period is found
_TABLES = {
    "region": ("Admin1", "SARTRE_GORDEL", {"JAAR": "2010 + r_regionkey"}),
    "nation": ("Admin1", "WEER", {"JAAR": "case when n_nationkey = 0 then -2000 else 2000 + n_nationkey end"}),
    "customer": ("Admin1", "customer", {}),
    "supplier": ("Admin1", "supplier", {"BEGDAT": "timestamp_ntz'2001-02-03 00:00:00'"}),
    "part": ("dbo", "part", {"ROWID": "p_partkey", "jaar": "1950 + p_size"}),
    "orders": ("Admin1", "orders", {"JAAR": "cast(year(o_orderdate) as int)"}),
    "lineitem": (
        "Admin1",
        "lineitem",
        {"BEGDAT": "l_shipdate", "ENDDAT": "case when l_linenumber = 1 then null else l_shipdate + interval 900 day end"},
    ),
    "events": ("Admin1", "events", {"WVK_BEGDAT": "ts", "WVK_EINDDAT": "cast(null as timestamp)"}),
    "documents": ("dbo", "documents", {}),
    "embeddings": ("dbo", "embeddings", {}),
    "pages": ("dbo", "pages", {}),
    "benchmark": ("dbo", "test", {}),
    "labels": ("dbo", "labels", {}),
    "conversations": ("dbo", "conversations", {"ROWID": "conv_id", "JAAR": "2000 + turn"}),
}
_WIDTHS = {
    "region": 3, "nation": 4, "customer": 5, "supplier": 5, "part": 7, "orders": 7, "lineitem": 13, "events": 8,
    "documents": 5, "embeddings": 3, "pages": 3, "labels": 3, "conversations": 5,
}
_PERIODS = {
    "region": ("1992", "2003"),
    "nation": ("1985", "max(2000 + n_nationkey)"),
    "part": ("min(1950 + p_size)", "max(1950 + p_size)"),
    "orders": ("min(year(o_orderdate))", "max(year(o_orderdate))"),
    "lineitem": (
        "year(min(l_shipdate))",
        "year(greatest(max(l_shipdate), max(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate + INTERVAL 900 DAY END)))",
    ),
    "events": ("year(min(ts))", "year(max(ts))"),
    "conversations": ("min(2000 + turn)", "max(2000 + turn)"),
}


def _profile_sql(name: str) -> str:
    schema, shown, _ = _TABLES[name]
    head = f"SELECT '{schema}' AS schema, '{shown.upper()}' AS dmx_naam"
    if shown == "test":
        return f"{head}, NULL::BIGINT AS rijen, NULL::INTEGER AS kolommen, NULL::INTEGER AS minY, NULL::INTEGER AS maxY"
    first, last = _PERIODS.get(name, ("NULL", "NULL"))
    return (
        f"{head}, count(*) AS rijen, {_WIDTHS[name]}::INTEGER AS kolommen, CAST({first} AS INTEGER) AS minY,"
        f" CAST({last} AS INTEGER) AS maxY FROM {name}"
    )


@checked("table_profile", " UNION ALL ".join(_profile_sql(n) for n in _TABLES))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {}
    for name, (schema, shown, extra) in _TABLES.items():
        df = table(spark, sf_dir, name)
        tables[schema, shown] = df.selectExpr("*", *[f"{e} AS {c}" for c, e in extra.items()])
    return profile_tables(tables)


_REGISTRY_CTE = f"""
sys AS (
  SELECT name AS dmx_naam, upper(name) AS Udmx_naam, CASE schema_id WHEN 1 THEN 'dbo' WHEN 5 THEN 'Admin1' END AS schema_naam
  FROM ({standins.CATALOG.sql}) WHERE schema_id <> 6),
prof AS ({standins.PROFILE.sql}),
dmx AS (SELECT dmx_nr, upper(dmx_naam) AS dmx_naam, dmx_type, dmx_omschrijving, dmx_pasop_nl FROM ({standins.MATRICES.sql})),
reg AS (
  SELECT coalesce(s.dmx_naam, d.dmx_naam) AS dmx_naam, s.schema_naam, p.rijen, p.kolommen, p.minY, p.maxY,
         d.dmx_nr, d.dmx_type, d.dmx_omschrijving, d.dmx_pasop_nl
  FROM sys s LEFT JOIN prof p ON p.dmx_naam = s.Udmx_naam AND p.schema = s.schema_naam
  FULL JOIN dmx d ON d.dmx_naam = s.dmx_naam)
"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_registry(
        system_tables(standins.CATALOG.read(spark, sf_dir)),
        standins.PROFILE.read(spark, sf_dir),
        standins.MATRICES.read(spark, sf_dir),
    )


@checked(
    "table_registry",
    f"""
    WITH {_REGISTRY_CTE}
    SELECT dmx_naam, upper(dmx_naam) AS Udmx_naam, schema_naam, dmx_nr, dmx_type, rijen FROM reg
    """,
)
def table_registry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select(
        "dmx_naam", "Udmx_naam", "schema_naam", "dmx_nr", "dmx_type", "rijen"
    )


_LISTED = sorted(_TABLES)


@checked(
    "catalogue_profile",
    " UNION ALL ".join(
        f"SELECT '{name}' AS tabelnaam, upper('{name}') AS dmx_naam, (SELECT count(*) FROM {name}) AS rijen,"
        f" (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = '{name}') AS kolommen"
        for name in _LISTED
    ),
)
def catalogue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given tables as a catalogue: listed, and profiled from the list. The catalogue goes when it has been read."""
    database = f"catalogus_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION :place", {"place": shared_dir(spark, database)})
    try:
        for name in _LISTED:
            spark.catalog.createTable(f"{database}.{name}", f"{sf_dir}/{name}.parquet", "parquet")
        tables = settle(listed_tables(table_list(spark, [database])), "listed")
        profile = profile_catalog(spark, [database]).drop("error")
    finally:
        # its tables are external: their files stay
        spark.sql(f"DROP DATABASE {database} CASCADE")
    both = left_lookup(tables, profile, {"Udmx_naam": "dmx_naam", "schema_naam": "schema"})
    return both.selectExpr("dmx_naam AS tabelnaam", "Udmx_naam AS dmx_naam", "rijen", "kolommen")


@checked(
    "data_overview",
    f"""
    WITH {_REGISTRY_CTE},
    src AS ({standins.SOURCES.sql}),
    geg AS (
      SELECT s.prod_nr, coalesce(s.dmx_nr, r.dmx_nr) AS dmx_nr, r.* EXCLUDE (dmx_nr)
      FROM src s FULL JOIN reg r ON r.dmx_nr IS NOT DISTINCT FROM s.dmx_nr),
    prod AS (
      SELECT *, CASE WHEN prod_update = 0 THEN 'informatie' WHEN prod_update = -1 THEN 'stopgezet' WHEN prod_update BETWEEN 30 AND 190 THEN 'semester'
                     WHEN prod_update BETWEEN 300 AND 370 THEN 'jaarlijks' WHEN prod_update > 370 THEN 'na meerdere jaren' ELSE 'anders' END AS Frequentie
      FROM ({standins.PRODUCTS.sql})),
    d AS (SELECT * FROM ({standins.DELIVERIES.sql}) WHERE prod_nr IS NOT NULL),
    lv AS (
      SELECT prod_nr, max(lever_datum) AS LaatsteLevering, max(lever_IB_klasse) AS lever_IBklasse, max(lever_IB_opvolging) AS lever_IBopvolging,
             count(*) AS lever_aantal,
             (array_agg(lever_voorwaarde ORDER BY lever_datum DESC NULLS FIRST, lever_nr DESC))[1] AS lever_voorwaarde
      FROM d GROUP BY prod_nr),
    pg AS (
      SELECT p.org_nr, p.prod_naam, p.prod_docu, p.prod_memo, p.prod_beheerder, p.Frequentie, l.LaatsteLevering, l.lever_voorwaarde,
             l.lever_IBklasse, l.lever_IBopvolging, l.lever_aantal, g.* EXCLUDE (prod_nr)
      FROM (prod p LEFT JOIN lv l ON l.prod_nr = p.prod_nr) FULL JOIN geg g ON g.prod_nr IS NOT DISTINCT FROM p.prod_nr),
    opg AS (
      SELECT o.org_naam_kort, pg.* FROM ({standins.ORGANISATIONS.sql}) o FULL JOIN pg ON pg.org_nr IS NOT DISTINCT FROM o.org_nr)
    SELECT prod_naam AS Product, org_naam_kort AS Bronhouder, prod_beheerder AS Prod_beheerder, prod_docu, prod_memo, Frequentie,
           coalesce(lever_aantal, 0) AS lever_aantal, CAST(LaatsteLevering AS VARCHAR) AS LaatsteLevering, lever_voorwaarde,
           lever_IBklasse, lever_IBopvolging, dmx_naam AS Tabel,
           CASE WHEN minY IS NULL AND maxY IS NULL THEN '' ELSE coalesce(CAST(minY AS VARCHAR), 'NA') || '-' || coalesce(CAST(maxY AS VARCHAR), 'NA') END AS Periode,
           dmx_omschrijving AS TabelOms, rijen, kolommen, dmx_pasop_nl AS TabelPasop
    FROM opg
    WHERE {visible_sql('dmx_naam')} AND NOT coalesce(dmx_type IN (2), false)
      AND (dmx_naam IS NULL OR schema_naam <> 'dbo' OR dmx_naam = upper(dmx_naam))
    """,
)
def data_overview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = data_overview(
        standins.ORGANISATIONS.read(spark, sf_dir),
        standins.PRODUCTS.read(spark, sf_dir),
        delivery_summary(standins.DELIVERIES.read(spark, sf_dir), tie_break=["lever_nr"]),
        standins.SOURCES.read(spark, sf_dir),
        _registry(spark, sf_dir),
        store=settle,
    )
    return out.withColumn("LaatsteLevering", F.col("LaatsteLevering").cast("string"))
