"""Scans, projections, predicates, text, sorting, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lacks_code, lacks_prefix, lacks_text, member, strict_if
from ..operators import append, arrange, codebook_slice, group_count, left_lookup
from ..plans.registry import visible_tables
from ..sources import scan, tagged, year_range
from . import standins
from .base import StandIn, checked, table


@checked(
    "scan_pushdown",
    """
    SELECT o_orderkey AS sleutel, o_orderkey AS ONG_ID, o_custkey AS klant, o_totalprice AS bedrag
    FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
      AND o_orderstatus = 'F' AND o_totalprice > 1000
    """,
)
def scan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(
        spark,
        f"{sf_dir}/orders.parquet",
        columns={
            "sleutel": "o_orderkey",
            "ONG_ID": "o_orderkey",
            "klant": "o_custkey",
            "bedrag": "o_totalprice",
        },
        where=f"{year_range('o_orderdate', 1996, 1998)} AND o_orderstatus = 'F' AND o_totalprice > 1000",
    )


_CODED = StandIn(
    "orders",
    {
        "code": "cast(nullif(o_custkey % 7, 0) as int)",
        "status": "o_orderstatus",
        "bedrag": "o_totalprice",
    },
)


@checked(
    "predicate_mix",
    f"""
    WITH codebook AS ({standins.CODEBOOK_SQL}), rows AS ({_CODED.sql})
    SELECT r.code, r.status, b.oms AS label, count(*) AS n,
           count(*) FILTER (WHERE r.code IS NOT NULL) AS bekend
    FROM rows r
    LEFT JOIN (SELECT code, oms FROM codebook WHERE var_naam = 'wegbeh' OR var_nr = 203) b
      ON b.code = CAST(r.code AS VARCHAR)
    WHERE r.bedrag > 50000 AND (r.status = 'F' OR r.code > 3 OR r.code IS NULL)
      AND r.status IN ('F', 'O') AND (r.code IS NULL OR r.code NOT IN (5))
    GROUP BY ALL
    """,
)
def predicate_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        _CODED.read(spark, sf_dir)
        .where("bedrag > 50000")
        .where("status = 'F' OR code > 3 OR code IS NULL")
        .where("status IN ('F', 'O')")
        .where(f"NOT {member('code', [5])}")
    )
    labels = codebook_slice(standins.codebook(spark), 203, "wegbeh").selectExpr("code", "oms AS label")
    counted = rows.groupBy("code", "status").agg(F.expr("count(1) AS n"), F.expr("count(code) AS bekend"))
    keyed = counted.selectExpr("*", "cast(code AS STRING) AS sleutel")
    return left_lookup(keyed, labels, {"sleutel": "code"}).drop("sleutel")


@checked(
    "sequential_overwrite",
    """
    WITH a AS (SELECT CAST(year(o_orderdate) % 100 AS INTEGER) AS jaar2, o_totalprice FROM orders),
    b AS (SELECT CASE WHEN jaar2 >= 95 THEN 1900 + jaar2 ELSE 2000 + jaar2 END AS jaar, o_totalprice FROM a),
    c AS (SELECT CAST(jaar AS INTEGER) AS jaar, CAST(jaar - jaar % 5 AS INTEGER) AS vijfjaar,
                 CASE WHEN o_totalprice > 250000 THEN 'hoog' ELSE 'laag' END AS klasse FROM b)
    SELECT jaar, vijfjaar, concat(klasse, ' ', CAST(vijfjaar AS VARCHAR)) AS klasse, count(*) AS n
    FROM c GROUP BY ALL
    """,
)
def sequential_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    steps = (
        orders.select(
            (F.year("o_orderdate") % 100).alias("jaar"),
            F.when(F.col("o_totalprice") > 250000, "hoog").otherwise("laag").alias("klasse"),
        )
        # each step reads the column that the step before has replaced
        .withColumn("jaar", F.expr(strict_if("jaar >= 95", "jaar + 1900", "jaar + 2000")))
        .withColumn("vijfjaar", F.expr("jaar - jaar % 5"))
        .withColumn("klasse", F.concat_ws(" ", "klasse", F.col("vijfjaar").cast("string")))
    )
    return group_count(steps, "jaar", "vijfjaar", "klasse")


@checked(
    "text_ops",
    """
    SELECT p_partkey, replace(p_name, ' ', ' t/m ') AS naam, upper(p_name) AS hoofdletters,
           contains(p_name, 'ring')::INTEGER AS ring, starts_with(p_name, 'small')::INTEGER AS klein
    FROM part WHERE contains(p_name, 'b')
    """,
)
def text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return (
        table(spark, sf_dir, "part")
        .where(name.contains("b"))
        .select(
            "p_partkey",
            F.replace(name, F.lit(" "), F.lit(" t/m ")).alias("naam"),
            F.upper(name).alias("hoofdletters"),
            name.contains("ring").cast("int").alias("ring"),
            name.startswith("small").cast("int").alias("klein"),
        )
    )


_MONTHS = StandIn(
    "orders",
    {
        "jaar": "cast(year(o_orderdate) as int)",
        "maand": "cast(nullif(month(o_orderdate), 6) as int)",
        "status": "o_orderstatus",
    },
)


@checked(
    "ordered_rows",
    f"""
    WITH m AS (SELECT jaar, maand, count(*) AS n FROM ({_MONTHS.sql}) GROUP BY ALL)
    SELECT jaar, n, CAST(row_number() OVER (ORDER BY jaar DESC NULLS LAST, maand ASC NULLS LAST) AS INTEGER) AS plaats
    FROM m
    """,
)
def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the position is taken over calendar months, of which there are few however many orders there are
    months = group_count(_MONTHS.read(spark, sf_dir), "jaar", "maand")
    order = Window.orderBy(F.col("jaar").desc_nulls_last(), F.col("maand").asc_nulls_last())
    placed = months.withColumn("plaats", F.row_number().over(order))
    return arrange(placed, "-jaar", "maand", drop=["maand"])


@checked(
    "side_file_union",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS Jaar, o_orderstatus AS status, 'hoofd' AS bron, count(*) AS n
    FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL
    UNION ALL
    SELECT 2001, o_orderstatus, 'na', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY ALL
    """,
)
def side_file_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    main = orders.where(year_range("o_orderdate", last=2000)).select(
        F.year("o_orderdate").alias("Jaar"), F.col("o_orderstatus").alias("status")
    )
    side = orders.where(year_range("o_orderdate", first=2001)).select(F.col("o_orderstatus").alias("status"))
    parts = append(tagged(main, bron="hoofd"), tagged(side, bron="na", Jaar=2001))
    return group_count(parts, "Jaar", "status", "bron")


_NAMES = StandIn(
    "part",
    {
        "naam": f"case when p_size = 7 then null else {standins._NAME} end",
        "soort": "cast(nullif(p_size % 5, 0) as int)",
        "schema_naam": "case when p_size = 9 then null when p_partkey % 4 = 0 then 'dbo' else 'Admin1' end",
    },
)
_HIDDEN = ["TRANS_", "REF_", "RUW_", "RAW_", "TEST", "COPY", "_2017", "_2018", "_TableColumnsUsed"]
_HIDDEN_UPPER = ["BCK", "BACK", "_OUD", "_OLD", "OLD_", "NB01_"]


def visible_sql(name: str) -> str:
    tests = [f"NOT coalesce(contains({name}, '{m}'), false)" for m in _HIDDEN]
    tests += [f"NOT coalesce(contains(upper({name}), '{m}'), false)" for m in _HIDDEN_UPPER]
    tests.append(f"NOT coalesce(substr({name}, 1, 2) = 'T_', false)")
    return " AND ".join(tests)


@checked(
    "exclude_names_nullsafe",
    f"""
    SELECT soort, schema_naam, (naam IS NULL)::INTEGER AS naamloos, count(*) AS n
    FROM ({_NAMES.sql})
    WHERE {visible_sql("naam")} AND NOT coalesce(soort IN (2), false)
      AND (naam IS NULL OR schema_naam <> 'dbo' OR naam = upper(naam))
    GROUP BY ALL
    """,
)
def exclude_names_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (
        _NAMES.read(spark, sf_dir)
        .where(visible_tables("naam"))
        .where(lacks_code("soort", 2))
        .where("naam IS NULL OR schema_naam <> 'dbo' OR naam = upper(naam)")
    )
    return group_count(
        kept.selectExpr("*", "cast(naam IS NULL AS INT) AS naamloos"), "soort", "schema_naam", "naamloos"
    )


@checked(
    "name_search",
    """
    SELECT p_brand, count(*) AS n FROM part
    WHERE contains(p_name, 'ring') AND NOT contains(p_type, 'LARGE') AND NOT starts_with(p_type, 'ECO')
    GROUP BY ALL
    """,
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = (
        table(spark, sf_dir, "part")
        .where("contains(p_name, 'ring')")
        .where(lacks_text("p_type", "LARGE"))
        .where(lacks_prefix("p_type", "ECO"))
    )
    return group_count(found, "p_brand")


@checked(
    "bulk_names",
    "SELECT r_regionkey AS datum, r_name AS tabelnaam FROM region",
)
def bulk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns named by place."""
    return table(spark, sf_dir, "region").toDF("datum", "tabelnaam")


@checked(
    "arithmetic",
    """
    SELECT -CAST(year(o_orderdate) AS INTEGER) AS aflopend, CAST(63 - 1 AS INTEGER) AS kolommen, count(*) AS n, CAST(sum(o_custkey - 1) AS BIGINT) AS som
    FROM orders GROUP BY ALL
    """,
)
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated years as a sort key, and one less of a count."""
    rows = table(spark, sf_dir, "orders").selectExpr("-year(o_orderdate) AS aflopend", "63 - 1 AS kolommen", "o_custkey - 1 AS som")
    return rows.groupBy("aflopend", "kolommen").agg(F.expr("count(1) AS n"), F.expr("sum(som) AS som"))
