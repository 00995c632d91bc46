"""Tables stored by year, late reports, footers, exact chunks, large key sets, and scans by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import group_count, interval_label, keep_many_keys, row_ranks, running_totals
from ..plans import accident_series, late_accidents, profile_stored, variable_lookup
from ..sources import (
    column_table,
    merge_late,
    of_years,
    parameter_scan,
    publish_counts,
    read_by_year,
    scan,
    settings,
    settle,
    shared_dir,
    sql_scan,
    write_by_year,
    write_exact_chunks,
)
from . import standins
from .base import ORACLES, StandIn, checked, table
from .recodes import AGES, STATISTICAL_BANDS, band_sql

TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders",
    "pages", "part", "region", "supplier",
]

# ---------------------------------------------------------------------------------- footers

_STORED = {
    "orders": {"JAAR": "cast(year(o_orderdate) as int)", "sleutel": "o_orderkey"},
    "lineitem": {
        "BEGDAT": "cast(l_shipdate as date)",
        "ENDDAT": "case when l_linenumber = 1 then null else cast(l_shipdate + interval 900 day as date) end",
        "ROWID": "l_orderkey",
    },
    "part": {"JAAR": "cast(case when p_size = 50 then null else 1950 + p_size end as int)"},
}


@checked(
    "stored_profile",
    """
    SELECT 'dbo' AS schema, 'ORDERS' AS dmx_naam, count(*) AS rijen, 2::INTEGER AS kolommen,
           CAST(min(year(o_orderdate)) AS INTEGER) AS minY, CAST(max(year(o_orderdate)) AS INTEGER) AS maxY FROM orders
    UNION ALL
    SELECT 'dbo', 'LINEITEM', count(*), 2::INTEGER, CAST(year(min(l_shipdate)) AS INTEGER),
           CAST(year(greatest(max(l_shipdate), max(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate + INTERVAL 900 DAY END))) AS INTEGER) FROM lineitem
    UNION ALL
    SELECT 'dbo', 'PART', count(*), 1::INTEGER, CAST(min(CASE WHEN p_size < 50 THEN 1950 + p_size END) AS INTEGER),
           CAST(max(CASE WHEN p_size < 50 THEN 1950 + p_size END) AS INTEGER) FROM part
    UNION ALL SELECT 'dbo', 'CUSTOMER', count(*), 5::INTEGER, NULL, NULL FROM customer
    UNION ALL SELECT 'dbo', 'EMBEDDINGS', count(*), 3::INTEGER, NULL, NULL FROM embeddings
    """,
)
def stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {("dbo", name): f"{sf_dir}/{name}.parquet" for name in ("customer", "embeddings")}
    for name, columns in _STORED.items():
        paths["dbo", name] = shared_dir(spark, name)
        StandIn(name, columns).read(spark, sf_dir).write.parquet(paths["dbo", name])
    return profile_stored(spark, paths)


# ---------------------------------------------------------------------------------- years


@checked("two_periods_by_year", ORACLES["two_period_series"])
def two_periods_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of two sources, from facts stored by year: the years of the other source are not opened."""
    places = {}
    for name, standin, year in (("new", standins.NEW_ACCIDENTS, "jaar"), ("old", standins.OLD_ACCIDENTS, "Jaar")):
        places[name] = shared_dir(spark, f"{name}-by-year")
        write_by_year(standin.read(spark, sf_dir), places[name], year)
    return accident_series(
        read_by_year(spark, places["new"], "jaar"),
        read_by_year(spark, places["old"], "Jaar"),
        late_accidents(standins.LATE_ACCIDENTS.read(spark, sf_dir)),
        standins.regions(spark, sf_dir),
        variable_lookup(standins.codebook(spark), "authority"),
    )


@checked(
    "facts_of_chosen_years",
    """
    WITH k AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS jaar, count(*) AS n FROM orders GROUP BY ALL)
    SELECT CAST(year(l_shipdate) AS INTEGER) AS jaar, l_returnflag AS vlag, count(*) AS n FROM lineitem
    WHERE year(l_shipdate) IN (SELECT jaar FROM k WHERE jaar % 2 = 0) GROUP BY ALL
    """,
)
def facts_of_chosen_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the even years among those that another table has; folders of other years are pruned at run time."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("year(l_shipdate) AS jaar", "l_returnflag AS vlag")
    write_by_year(lines, path := shared_dir(spark, "lines-by-year"), "jaar")
    years = group_count(table(spark, sf_dir, "orders"), F.year("o_orderdate").alias("jaar"))
    facts = of_years(read_by_year(spark, path, "jaar"), settle(years, "years"), "jaar", "jaar % 2 = 0")
    return group_count(facts, "jaar", "vlag")


_LATE = "o_custkey % 17 = 3 AND year(o_orderdate) IN (1996, 1998)"


@checked(
    "late_merge",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS jaar, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS prioriteit, count(*) AS n,
           CAST(year(o_orderdate) IN (1996, 1998) AS INTEGER) AS herschreven
    FROM orders GROUP BY ALL
    """,
)
def late_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published counts, brought up to date with the late reports of two years; tells which years were written anew."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "year(o_orderdate) AS jaar", "nullif(o_orderstatus, 'P') AS status", "o_orderpriority AS prioriteit", f"{_LATE} AS laat"
    )
    keys = ["jaar", "status", "prioriteit"]
    publish_counts(group_count(rows.where("NOT laat"), *keys), path := shared_dir(spark, "published"), "jaar")
    files = "split(input_file_name(), '/') AS _f"
    before = settle(read_by_year(spark, path, "jaar").selectExpr(files).selectExpr("element_at(_f, -1) AS bestand").distinct(), "files")
    merge_late(group_count(rows.where("laat"), *keys), path, "naijlers 1", keys, "n", "jaar")
    after = read_by_year(spark, path, "jaar").selectExpr("*", files).selectExpr(*keys, "n", "element_at(_f, -1) AS bestand")
    marked = after.join(before.withColumn("_oud", F.lit(1)), "bestand", "left")
    return marked.selectExpr(*keys, "n", "if(_oud IS NULL, 1, 0) AS herschreven")


# ---------------------------------------------------------------------------------- orders without bound


@checked(
    "running_total_groups",
    """
    WITH g AS (SELECT o_custkey AS klant, o_orderpriority AS prioriteit, count(*) AS n FROM orders GROUP BY ALL)
    SELECT *, CAST(sum(n) OVER (ORDER BY klant DESC, prioriteit) AS BIGINT) AS cum FROM g
    """,
)
def running_total_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = group_count(orders, F.col("o_custkey").alias("klant"), F.col("o_orderpriority").alias("prioriteit"))
    return running_totals(counts, [F.col("klant").desc(), F.col("prioriteit")], "n", settle, rows=500)


@checked(
    "row_places",
    """
    SELECT l_orderkey, l_linenumber, l_quantity AS aantal, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS volgnr FROM lineitem
    """,
)
def row_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("aantal"))
    return row_ranks(lines, [F.col("aantal").desc(), F.col("l_orderkey"), F.col("l_linenumber")], settle, rows=2000)


@checked(
    "exact_chunks",
    """
    WITH r AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS Jaar, row_number() OVER (ORDER BY year(l_shipdate) DESC) AS volgnr FROM lineitem),
    lim AS (SELECT CAST(floor(count(*) / 7) AS BIGINT) AS lim FROM lineitem)
    SELECT CAST((volgnr - 1) // lim + 1 AS INTEGER) AS serie, Jaar, count(*) AS n, min(volgnr) AS van, max(volgnr) AS tot FROM r, lim GROUP BY ALL
    """,
)
def exact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a seventh of the rows each, newest first; a year may be in two of them."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("Jaar"), "l_orderkey", "l_quantity")
    path = shared_dir(spark, "exact")
    write_exact_chunks(lines, path, [F.col("Jaar").desc_nulls_last()], limit=lines.count() // 7, rows=2000)
    written = scan(spark, path)
    return written.groupBy(F.col("serie").cast("int").alias("serie"), "Jaar").agg(
        F.expr("count(1) AS n"), F.expr("min(volgnr) AS van"), F.expr("max(volgnr) AS tot")
    )


# ---------------------------------------------------------------------------------- keys and bands

# what Spark would do by itself from 10 GB of facts on
_FILTERED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


@checked(
    "many_keys_semi",
    """
    SELECT l_orderkey AS sleutel, l_linenumber AS nummer FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 4 AND o_orderstatus <> 'P')
    """,
)
def many_keys_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the orders of some customers; the lines are tested against a Bloom filter before they are shuffled."""
    chosen = table(spark, sf_dir, "orders").where("o_custkey % 9 = 4 AND o_orderstatus <> 'P'")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sleutel", "l_linenumber AS nummer")
    with settings(spark, _FILTERED):
        return settle(keep_many_keys(lines, chosen, {"sleutel": "o_orderkey"}, settle), "kept")


@checked(
    "age_band_from_table",
    f"SELECT lft, {band_sql('lft', STATISTICAL_BANDS)} AS Leeftijd_stat, count(*) AS n FROM ({AGES.sql}) GROUP BY ALL",
)
def age_band_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age bands out of a stored table of ranges."""
    # the ranges as a table would hold them: the nation table's first rows dressed as ten ranges
    ends = table(spark, sf_dir, "nation").where("n_nationkey < 10").selectExpr(
        "element_at(array(0, 15, 20, 25, 30, 40, 50, 60, 70, 80), n_nationkey + 1) AS van",
        "element_at(array(14, 19, 24, 29, 39, 49, 59, 69, 79, 120), n_nationkey + 1) AS tot",
    )
    ranges = settle(ends.selectExpr("van", "tot", "if(van = 80, '80+', concat(van, '-', tot, ' jaar')) AS klasse"), "ranges")
    counts = group_count(AGES.read(spark, sf_dir), "lft")
    outside = "CASE WHEN lft = 32760 THEN 'Onbekend' ELSE cast(lft AS STRING) END"
    return interval_label(counts, "lft", ranges, "Leeftijd_stat", "van", "tot", "klasse", outside).select("lft", "Leeftijd_stat", "n")


# ---------------------------------------------------------------------------------- text scans and column lists


@checked(
    "text_scan",
    """
    SELECT o_orderkey AS sleutel, o_orderkey AS naam, o_orderpriority AS prioriteit FROM orders
    WHERE o_orderpriority NOT IN ('it''s "x" \\ y', '5-LOW') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey BETWEEN 10 AND 900
    UNION ALL
    SELECT c_custkey, c_custkey, 'it''s "x" \\ y' FROM customer WHERE c_mktsegment IN ('BUILDING', 'a''b\\')
    """,
)
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans by query text whose values hold quotes and backslashes; none of them is written into the text."""
    odd = 'it\'s "x" \\ y'
    columns = {"sleutel": "o_orderkey", "naam": "o_orderkey", "prioriteit": "o_orderpriority"}
    tests = [
        ("o_orderpriority", "<>", odd),
        ("o_orderpriority", "<>", "5-LOW"),
        ("o_orderdate", ">=", "1996-01-01"),
        ("o_custkey", "between", 10, 900),
    ]
    orders = parameter_scan(spark, table(spark, sf_dir, "orders"), columns, tests)
    customers = sql_scan(
        spark,
        "SELECT IDENTIFIER(:key), IDENTIFIER(:key), :odd FROM {customers} WHERE c_mktsegment IN (:a, :b)",
        {"key": "c_custkey", "odd": odd, "a": "BUILDING", "b": "a'b\\"},
        customers=table(spark, sf_dir, "customer"),
    )
    return orders.unionAll(customers)


@checked(
    "table_columns",
    f"""
    SELECT table_name AS tabelnaam, column_name AS kolom, CAST(ordinal_position AS INTEGER) AS plaats FROM information_schema.columns
    WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})
    """,
)
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_table(spark, {name: table(spark, sf_dir, name) for name in TABLES})
