"""Lookups, joins and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import to_int
from ..operators import (
    append,
    attach,
    flag_present,
    full_merge,
    group_count,
    group_sum,
    keep_keys,
    left_lookup,
    missing_from,
    with_summary,
)
from ..plans import variable_lookup
from ..sources import settle
from . import standins
from .base import StandIn, checked, table


@checked(
    "lookup_label",
    """
    WITH c AS (
      SELECT c_mktsegment, try_cast(CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS INTEGER) AS land
      FROM customer)
    SELECT c.c_mktsegment AS segment, n.n_name AS land, r.r_name AS werelddeel, count(*) AS n
    FROM c LEFT JOIN nation n ON n.n_nationkey = c.land LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    GROUP BY ALL
    """,
)
def lookup_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE cast(c_nationkey AS STRING) END"
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment AS segment", f"{to_int(code)} AS land_nr"
    )
    nations = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "n_name AS land", "n_regionkey AS deel_nr"
    )
    regions = table(spark, sf_dir, "region").selectExpr("r_regionkey", "r_name AS werelddeel")
    counted = group_count(customers, "segment", "land_nr")
    named = left_lookup(counted, nations, {"land_nr": "n_nationkey"})
    named = left_lookup(named, regions, {"deel_nr": "r_regionkey"})
    return named.select("segment", "land", "werelddeel", "n")


_NULL_KEY_LABELS = (
    "SELECT * FROM (VALUES (CAST(NULL AS INT), 'zonder code'), (1, 'een'), (2, 'twee'), (9, 'negen')) AS t(k, label)"
)


@checked(
    "lookup_null_key",
    f"""
    WITH o AS (SELECT CAST(nullif(o_custkey % 7, 0) AS INTEGER) AS code, o_orderstatus FROM orders)
    SELECT o.code, l.label, o.o_orderstatus AS status, count(*) AS n
    FROM o LEFT JOIN ({_NULL_KEY_LABELS}) l ON l.k IS NOT DISTINCT FROM o.code GROUP BY ALL
    """,
)
def lookup_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.nullif(F.col("o_custkey") % 7, F.lit(0)).cast("int").alias("code"),
        F.col("o_orderstatus").alias("status"),
    )
    return left_lookup(group_count(rows, "code", "status"), spark.sql(_NULL_KEY_LABELS), {"code": "k"}, null_safe=True)


_CASUALTY = StandIn(
    "lineitem",
    {
        "vornum": "cast(l_orderkey as string)",
        "wegbeh": "cast(nullif(l_orderkey % 5, 0) as int)",
        "aantal": "cast(l_quantity as bigint)",
    },
)
_ACCIDENT = StandIn(
    "orders",
    {
        "VORNUM_NR": "o_orderkey",
        "beheer": "cast(case when o_custkey % 9 = 0 then 77 else nullif(o_orderkey % 5, 0) end as int)",
        "ernst": "o_orderstatus",
    },
)


@checked(
    "composite_join",
    f"""
    SELECT a.ernst, c.wegbeh, count(*) AS n, CAST(sum(c.aantal) AS BIGINT) AS aantal
    FROM ({_CASUALTY.sql}) c LEFT JOIN ({_ACCIDENT.sql}) a
      ON a.VORNUM_NR = CAST(c.vornum AS BIGINT) AND a.beheer IS NOT DISTINCT FROM c.wegbeh
    GROUP BY ALL
    """,
)
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    casualties = _CASUALTY.read(spark, sf_dir).withColumn("vornum", F.expr("cast(vornum AS BIGINT)"))
    # counted on the join keys first, so a hot accident is one row per task when it is shuffled
    sums = [F.expr("count(1) AS n"), F.expr("sum(aantal) AS aantal")]
    counted = casualties.groupBy("vornum", "wegbeh").agg(*sums)
    joined = attach(
        counted,
        _ACCIDENT.read(spark, sf_dir),
        {"vornum": "VORNUM_NR", "wegbeh": "beheer"},
        null_safe=["wegbeh"],
    )
    return joined.groupBy("ernst", "wegbeh").agg(F.expr("sum(n) AS n"), F.expr("sum(aantal) AS aantal"))


@checked(
    "keys_semi",
    """
    SELECT o_orderpriority AS prioriteit, count(*) AS n, count(DISTINCT o_custkey) AS klanten FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)
    GROUP BY ALL
    """,
)
def keys_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").where(
        (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)
    )
    # counted per customer first: a hot customer is one row in the join, and no distinct set is built
    per_customer = group_count(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")
    kept = keep_keys(per_customer, chosen, {"o_custkey": "c_custkey"})
    return kept.groupBy(F.col("o_orderpriority").alias("prioriteit")).agg(
        F.expr("sum(n) AS n"), F.expr("count(1) AS klanten")
    )


@checked(
    "missing_names",
    """
    WITH beschreven AS (
      SELECT p_partkey, upper(CASE WHEN p_size <= 10 THEN 'ONTBREEKT' ELSE p_name END) AS naam, p_size FROM part),
    aanwezig AS (SELECT DISTINCT upper(p_name) AS naam FROM part WHERE p_size > 30)
    SELECT 'afwezig' AS soort, naam, count(*) AS n FROM beschreven
      WHERE naam NOT IN (SELECT naam FROM aanwezig) GROUP BY ALL
    UNION ALL
    SELECT CASE WHEN naam IN (SELECT naam FROM aanwezig) THEN 'ja' ELSE 'nee' END, NULL, count(*)
    FROM beschreven GROUP BY ALL
    """,
)
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") <= 10, "ONTBREEKT").otherwise(F.col("p_name"))
    described = group_count(part.select(F.upper(name).alias("naam")), "naam")
    present = part.where(F.col("p_size") > 30).select(F.upper("p_name").alias("naam"))
    absent = missing_from(described, present, "naam")
    flagged = flag_present(described, present, "naam", "aanwezig")
    counts = group_sum(flagged.selectExpr("if(aanwezig, 'ja', 'nee') AS soort", "n"), "soort", measure="n")
    return append(
        absent.select(F.lit("afwezig").alias("soort"), "naam", "n"),
        counts.select("soort", F.lit(None).cast("string").alias("naam"), "n"),
    )


@checked(
    "absent_orders",
    """
    SELECT c_mktsegment AS segment, count(*) AS n FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY ALL
    """,
)
def absent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000)
    return group_count(
        missing_from(table(spark, sf_dir, "customer"), large, {"c_custkey": "o_custkey"}),
        F.col("c_mktsegment").alias("segment"),
    )


_CUSTOMER_NATIONS = StandIn(
    "customer",
    {"land": "cast(case when c_nationkey > 17 then null else c_nationkey end as int)", "klant": "c_custkey"},
)
_SUPPLIER_NATIONS = StandIn(
    "supplier",
    {"land": "cast(case when s_nationkey = 2 then null else s_nationkey + 2 end as int)", "saldo": "s_acctbal"},
)


@checked(
    "full_outer_coalesced",
    f"""
    WITH a AS (SELECT land, count(*) AS klanten FROM ({_CUSTOMER_NATIONS.sql}) GROUP BY ALL),
         b AS (SELECT land, count(*) AS leveranciers FROM ({_SUPPLIER_NATIONS.sql}) GROUP BY ALL)
    SELECT CASE WHEN a.klanten IS NULL THEN b.land ELSE a.land END AS land, a.klanten, b.leveranciers
    FROM a FULL JOIN b ON a.land IS NOT DISTINCT FROM b.land
    """,
)
def full_outer_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = group_count(_CUSTOMER_NATIONS.read(spark, sf_dir), "land", name="klanten")
    suppliers = group_count(_SUPPLIER_NATIONS.read(spark, sf_dir), "land", name="leveranciers")
    return full_merge(customers, suppliers, "land")


@checked(
    "full_outer_detail",
    f"""
    WITH a AS ({_CUSTOMER_NATIONS.sql}),
         b AS (SELECT land, count(*) AS leveranciers FROM ({_SUPPLIER_NATIONS.sql}) GROUP BY ALL)
    SELECT CASE WHEN a.klant IS NULL THEN b.land ELSE a.land END AS land, a.klant, b.leveranciers
    FROM a FULL JOIN b ON a.land IS NOT DISTINCT FROM b.land
    """,
)
def full_outer_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = group_count(_SUPPLIER_NATIONS.read(spark, sf_dir), "land", name="leveranciers")
    # settled, so that its size is known and the customers need no shuffle
    return full_merge(_CUSTOMER_NATIONS.read(spark, sf_dir), settle(suppliers, "suppliers"), "land")


@checked(
    "detail_with_group_summary",
    """
    WITH d AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS jaar FROM orders),
    s AS (SELECT jaar, count(*) AS grootte, min(o_orderkey) AS eerste, max(o_orderkey) AS laatste FROM d GROUP BY jaar)
    SELECT d.o_orderkey, d.jaar, s.grootte, s.eerste, s.laatste FROM s RIGHT JOIN d ON d.jaar = s.jaar
    """,
)
def detail_with_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("jaar"))
    summary = detail.groupBy("jaar").agg(
        F.count(F.lit(1)).alias("grootte"),
        F.min("o_orderkey").alias("eerste"),
        F.max("o_orderkey").alias("laatste"),
    )
    # the year of a date: at most 9 999 groups
    return with_summary(detail, summary, "jaar", bounded=True)


@checked(
    "successor_mapping",
    f"""
    WITH {standins.REGIONS_CTE},
    k AS (SELECT {standins._municipality('c_custkey')} AS gemeente_nr FROM customer)
    SELECT k.gemeente_nr, r.gemeente_nr_recent, r.Gemeente_naam_recent, r.Gemeente_naam, r.Provincie,
           r.Politieregio, r.Eenheid, count(*) AS n
    FROM k LEFT JOIN regions r ON r.gemeente_nr = k.gemeente_nr GROUP BY ALL
    """,
)
def successor_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr(
        f"{standins._municipality('c_custkey')} AS gemeente_nr"
    )
    return left_lookup(
        group_count(customers, "gemeente_nr"), standins.regions(spark, sf_dir), "gemeente_nr", unique=False
    )


@checked(
    "codebook_dimension",
    f"""
    WITH codebook AS ({standins.CODEBOOK_SQL}),
    p AS (SELECT try_cast(code AS INTEGER) AS prov,
                 CASE oms WHEN 'FryslÃ¢n' THEN 'Fryslân' WHEN 'Overyssel' THEN 'Overijssel'
                   WHEN 'Overyssel + Flevoland' THEN 'Overijssel + Flevoland' ELSE oms END AS Provincie
          FROM codebook WHERE var_naam = 'prov_ivo' OR var_nr = 556)
    SELECT CAST(s_nationkey % 6 AS INTEGER) AS prov, p.Provincie, count(*) AS n
    FROM supplier LEFT JOIN p ON p.prov = s_nationkey % 6 GROUP BY ALL
    """,
)
def codebook_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    provinces = variable_lookup(standins.codebook(spark), "rate_province")
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 6).cast("int").alias("prov"))
    return left_lookup(group_count(suppliers, "prov"), provinces, {"prov": "code"})


@checked(
    "codebook_of_used_keys",
    f"""
    WITH codebook AS ({standins.CODEBOOK_SQL})
    SELECT var_nr, code, oms, count(*) AS n FROM codebook
    WHERE CAST(var_nr AS BIGINT) IN (SELECT DISTINCT p_size * 5 FROM part) GROUP BY ALL
    """,
)
def codebook_of_used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "part").select((F.col("p_size") * 5).alias("var_nr"))
    return group_count(keep_keys(standins.codebook(spark), used, "var_nr"), "var_nr", "code", "oms")
