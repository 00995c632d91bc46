"""Bands, code sets, label repairs, strict choices and period texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    codes,
    first_match,
    label_map,
    literal,
    paste,
    period_text,
    recode,
    repair_text,
    strict_if,
)
from ..operators import group_count
from ..plans import add_age_labels
from .base import StandIn, checked, table


def band_sql(col: str, bands: list[tuple[int, int, str]]) -> str:
    cases = " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN '{label}'" for lo, hi, label in bands)
    return f"CASE {cases} WHEN {col} = 32760 THEN 'Onbekend' ELSE CAST({col} AS VARCHAR) END"


# fixed values: the bands, written out for the SQL, so that a wrong band in the code does not agree with itself
FINE_BANDS = [
    (0, 5, " 0- 5 jaar"), (6, 11, " 6-11 jaar"), (12, 14, "12-14 jaar"), (15, 17, "15-17 jaar"), (18, 19, "18-19 jaar"), (20, 24, "20-24 jaar"),
    (25, 29, "25-29 jaar"), (30, 34, "30-34 jaar"), (35, 39, "35-39 jaar"), (40, 44, "40-44 jaar"), (45, 49, "45-49 jaar"), (50, 54, "50-54 jaar"),
    (55, 59, "55-59 jaar"), (60, 64, "60-64 jaar"), (65, 69, "65-69 jaar"), (70, 74, "70-74 jaar"), (75, 79, "75-79 jaar"), (80, 84, "80-84 jaar"),
    (85, 89, "85-89 jaar"), (90, 94, "90-94 jaar"), (95, 120, "95+"),
]
STATISTICAL_BANDS = [
    (0, 14, "0-14 jaar"), (15, 19, "15-19 jaar"), (20, 24, "20-24 jaar"), (25, 29, "25-29 jaar"), (30, 39, "30-39 jaar"), (40, 49, "40-49 jaar"),
    (50, 59, "50-59 jaar"), (60, 69, "60-69 jaar"), (70, 79, "70-79 jaar"), (80, 120, "80+"),
]

AGES = StandIn(
    "part",
    {
        "lft": "cast(case p_size when 50 then 32760 when 49 then null else p_size * 3 end as int)",
        "merk": "p_brand",
    },
)


@checked(
    "age_band",
    f"""
    SELECT lft, {band_sql('lft', FINE_BANDS)} AS Leeftijd,
           {band_sql('lft', STATISTICAL_BANDS)} AS Leeftijd_stat, count(*) AS n
    FROM ({AGES.sql}) GROUP BY ALL
    """,
)
def age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_age_labels(group_count(AGES.read(spark, sf_dir), "lft"), "lft")


_CODES = StandIn(
    "lineitem",
    {
        "code": "cast(nullif(l_linenumber * 3 + l_partkey % 5, 9) as int)",
        "status": "l_linestatus",
    },
)


@checked(
    "code_recode",
    f"""
    WITH c AS ({_CODES.sql}),
    r AS (SELECT CASE WHEN code IN (3, 4, 5) THEN 'laag' WHEN code IN (5, 6, 7, 8) THEN 'midden'
                      WHEN code > 15 OR status = 'F' THEN 'hoog' ELSE 'overig' END AS klasse,
                 CASE WHEN code IN (10, 11) THEN 'IM' WHEN code = 12 THEN 'KMM' END AS melding FROM c)
    SELECT klasse, melding, count(*) AS n FROM r GROUP BY ALL
    """,
)
def code_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = first_match([("code > 15 OR status = 'F'", "hoog")], literal("overig"))
    rows = _CODES.read(spark, sf_dir).selectExpr(
        f"{recode('code', [([3, 4, 5], 'laag'), ([5, 6, 7, 8], 'midden')], high)} AS klasse",
        f"{recode('code', [([10, 11], 'IM'), ([12], 'KMM')])} AS melding",
    )
    return group_count(rows, "klasse", "melding")


@checked(
    "label_cleanup",
    """
    WITH p AS (SELECT CASE p_type WHEN 'SMALL' THEN 'FryslÃ¢n' WHEN 'LARGE' THEN 'Overyssel' WHEN 'PROMO' THEN NULL ELSE p_type END AS t, p_brand FROM part)
    SELECT CASE t WHEN 'FryslÃ¢n' THEN 'Fryslân' WHEN 'Overyssel' THEN 'Overijssel'
             WHEN 'Overyssel + Flevoland' THEN 'Overijssel + Flevoland' ELSE t END AS label, p_brand AS merk, count(*) AS n
    FROM p GROUP BY ALL
    """,
)
def label_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE p_type WHEN 'SMALL' THEN 'FryslÃ¢n' WHEN 'LARGE' THEN 'Overyssel' ELSE nullif(p_type, 'PROMO') END"
    labelled = (
        table(spark, sf_dir, "part")
        .selectExpr(f"{raw} AS soort", "p_brand AS merk")
        .selectExpr(f"{label_map('soort', codes.RATE_PROVINCE_REPAIRS)} AS label", "merk")
    )
    return group_count(labelled, "label", "merk")


@checked("mojibake", "SELECT doc_id, lang, md5(text) AS tekst_md5, length(text) AS lengte FROM documents")
def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every other text is broken the way a Latin-1 reader breaks UTF-8; all must come out whole
    broken = "if(doc_id % 2 = 0, decode(encode(text, 'UTF-8'), 'ISO-8859-1'), text) AS tekst"
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id", "lang", broken)
        .selectExpr("doc_id", "lang", f"{repair_text('tekst')} AS tekst")
        .selectExpr("doc_id", "lang", "md5(tekst) AS tekst_md5", "cast(length(tekst) AS BIGINT) AS lengte")
    )


@checked(
    "strict_if_else",
    """
    WITH o AS (SELECT CAST(nullif(o_custkey % 5, 0) AS INTEGER) AS code, CAST(year(o_orderdate) AS INTEGER) AS jaar FROM orders),
    s AS (SELECT CASE WHEN code > 2 THEN 'hoog' WHEN NOT (code > 2) THEN 'laag' END AS streng,
                 CASE WHEN code > 2 THEN 'hoog' ELSE 'laag' END AS ruim, jaar FROM o)
    SELECT streng, ruim, jaar, count(*) AS n FROM s GROUP BY ALL
    """,
)
def strict_if_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "orders")
        .selectExpr("nullif(o_custkey % 5, 0) AS code", "year(o_orderdate) AS jaar")
        .selectExpr(
            f"{strict_if('code > 2', literal('hoog'), literal('laag'))} AS streng",
            f"{first_match([('code > 2', 'hoog')], literal('laag'))} AS ruim",
            "jaar",
        )
    )
    return group_count(rows, "streng", "ruim", "jaar")


@checked(
    "period_text",
    """
    WITH y AS (SELECT CAST(nullif(o_custkey % 50, 7) AS INTEGER) AS groep,
                      CASE WHEN o_custkey % 50 < 20 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS eerste,
                      CASE WHEN o_custkey % 50 < 30 AND o_custkey % 3 = 0 THEN NULL
                           WHEN o_custkey % 50 < 10 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS laatste FROM orders),
    g AS (SELECT groep, min(eerste) AS a, max(laatste) AS b, count(*) AS n FROM y GROUP BY groep)
    SELECT groep, CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE
                    coalesce(CAST(a AS VARCHAR), 'NA') || '-' || coalesce(CAST(b AS VARCHAR), 'NA') END AS Periode,
           coalesce(CAST(a AS VARCHAR), 'NA') || ' tm ' || coalesce(CAST(b AS VARCHAR), 'NA') AS lever_perioden, n FROM g
    """,
)
def period_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = (
        table(spark, sf_dir, "orders")
        .selectExpr("o_custkey", "o_custkey % 50 AS rest", "year(o_orderdate) AS jaar")
        .selectExpr(
            "cast(nullif(rest, 7) AS INT) AS groep",
            "if(rest >= 20, jaar, NULL) AS eerste",
            "if(rest >= 10 AND (rest >= 30 OR o_custkey % 3 <> 0), jaar, NULL) AS laatste",
        )
        .groupBy("groep")
        .agg(F.expr("min(eerste) AS a"), F.expr("max(laatste) AS b"), F.expr("count(1) AS n"))
    )
    return grouped.selectExpr(
        "groep", f"{period_text('a', 'b')} AS Periode", f"{paste('a', 'b', sep=' tm ')} AS lever_perioden", "n"
    )

