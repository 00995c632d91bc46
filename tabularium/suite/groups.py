"""Counts, sums, contingency and wide tables, roll-ups, reconciliation, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    contingency,
    group_count,
    group_sum,
    last_per_group,
    pack_years,
    reconcile,
    reshape_wide,
    rollups,
    rollups_tagged,
    running_total,
    weighted_count,
    wide_count,
)
from ..sources import settle, shared_dir, write_preserving
from .base import StandIn, checked, table

YEARS = list(range(1995, 2002))

_LINES = StandIn(
    "lineitem",
    {
        "jaar": "cast(year(l_shipdate) as int)",
        "vlag": "l_returnflag",
        "status": "l_linestatus",
        "nummer": "l_linenumber",
        "aantal": "cast(case when l_returnflag = 'N' and l_linestatus = 'F' then null"
        " else nullif(l_quantity, 13) end as bigint)",
    },
)
_ORDERS = StandIn(
    "orders",
    {
        "jaar": "cast(year(o_orderdate) as int)",
        "prioriteit": "nullif(o_orderpriority, '5-LOW')",
        "status": "nullif(o_orderstatus, 'P')",
    },
)


@checked(
    "group_count",
    f"SELECT vlag, status, nummer, count(*) AS Aantal FROM ({_LINES.sql}) GROUP BY ALL",
)
def group_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_count(_LINES.read(spark, sf_dir), "vlag", "status", "nummer", name="Aantal")


@checked(
    "group_sum_nullsafe",
    f"""
    SELECT jaar, vlag, status, CAST(coalesce(sum(aantal), 0) AS BIGINT) AS aantal
    FROM ({_LINES.sql}) GROUP BY ALL
    """,
)
def group_sum_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sum(_LINES.read(spark, sf_dir), "jaar", "vlag", "status", measure="aantal")


@checked(
    "weighted_count",
    f"""
    SELECT jaar, nummer, CAST(coalesce(sum(aantal), 0) AS BIGINT) AS n
    FROM ({_LINES.sql}) GROUP BY ALL
    """,
)
def weighted_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_count(_LINES.read(spark, sf_dir), "jaar", "nummer", weight="aantal")


@checked(
    "last_per_group",
    """
    WITH o AS (
      SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '5-LOW') AS prioriteit, o_orderstatus AS status,
             CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS datum FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY datum DESC NULLS FIRST, o_orderkey DESC) AS rn FROM o)
    SELECT o_custkey AS klant, prioriteit, status FROM r WHERE rn = 1
    """,
)
def last_per_group_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("klant"),
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prioriteit"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("datum"),
    )
    return last_per_group(orders, ["klant"], ["datum", "o_orderkey"], ["prioriteit", "status"])


_CELLS = ", ".join(f"count(*) FILTER (WHERE jaar = {y}) AS \"{y}\"" for y in YEARS)


@checked(
    "contingency",
    f"SELECT prioriteit, {_CELLS} FROM ({_ORDERS.sql}) WHERE prioriteit IS NOT NULL AND jaar IS NOT NULL GROUP BY ALL",
)
def contingency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contingency(_ORDERS.read(spark, sf_dir), "prioriteit", "jaar", YEARS)


@checked(
    "contingency_na",
    f"""
    SELECT coalesce(prioriteit, 'NA') AS prioriteit,
           count(*) FILTER (WHERE status = 'F') AS "F", count(*) FILTER (WHERE status = 'O') AS "O",
           count(*) FILTER (WHERE status IS NULL) AS "NA"
    FROM ({_ORDERS.sql}) GROUP BY ALL
    """,
)
def contingency_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contingency(_ORDERS.read(spark, sf_dir), "prioriteit", "status", ["F", "O"], missing_level=True)


_WEIGHTED_CELLS = ", ".join(
    f"CAST(CASE WHEN count(*) FILTER (WHERE jaar = {y}) = 0 THEN NULL"
    f" ELSE coalesce(sum(aantal) FILTER (WHERE jaar = {y}), 0) END AS BIGINT) AS y{y}"
    for y in YEARS
)


@checked(
    "pivot_weighted",
    f"""
    SELECT vlag, groep, {_WEIGHTED_CELLS}
    FROM (SELECT *, CASE WHEN vlag = 'A' AND jaar = 1997 THEN 'apart' ELSE CAST(nummer AS VARCHAR) END AS groep FROM ({_LINES.sql}))
    GROUP BY ALL
    """,
)
def pivot_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one year of one flag forms a group of its own, so that there are cells without rows
    group = "CASE WHEN vlag = 'A' AND jaar = 1997 THEN 'apart' ELSE cast(nummer AS STRING) END AS groep"
    rows = _LINES.read(spark, sf_dir).selectExpr("*", group)
    return wide_count(rows, "vlag", "groep", period="jaar", periods=YEARS, weight="aantal", prefix="y")


@checked(
    "pivot_reshape",
    f"""
    WITH c AS (SELECT prioriteit, status, jaar, count(*) AS n FROM ({_ORDERS.sql}) GROUP BY ALL)
    SELECT prioriteit, status, {", ".join(f'max(n) FILTER (WHERE jaar = {y}) AS y{y}' for y in YEARS)}
    FROM c GROUP BY ALL
    """,
)
def pivot_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = group_count(_ORDERS.read(spark, sf_dir), "prioriteit", "status", "jaar")
    return reshape_wide(counted, "jaar", "n", YEARS, prefix="y")


@checked(
    "rollups",
    """
    WITH base AS (
      SELECT CAST(nullif(year(o.o_orderdate), 1999) AS INTEGER) AS jaar, nullif(o.o_orderstatus, 'P') AS status, nullif(o.o_orderpriority, '5-LOW') AS prioriteit,
             CAST(sum(l_quantity) AS BIGINT) AS n
      FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey GROUP BY ALL)
    SELECT 'jaar' AS tabel, jaar, NULL AS status, NULL AS prioriteit, CAST(sum(n) AS BIGINT) AS n FROM base GROUP BY jaar
    UNION ALL SELECT 'status', jaar, status, NULL, CAST(sum(n) AS BIGINT) FROM base GROUP BY jaar, status
    UNION ALL SELECT 'prioriteit', NULL, status, prioriteit, CAST(sum(n) AS BIGINT) FROM base GROUP BY status, prioriteit
    """,
)
def rollups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_quantity AS BIGINT) AS n")
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "nullif(year(o_orderdate), 1999) AS jaar", "nullif(o_orderstatus, 'P') AS status", "nullif(o_orderpriority, '5-LOW') AS prioriteit"
    )
    # quantities are added up per order first; the join then finds them shuffled on its key
    per_order = group_sum(lines, "l_orderkey", measure="n")
    joined = per_order.join(orders, F.expr("l_orderkey = o_orderkey"))
    base = group_sum(joined, "jaar", "status", "prioriteit", measure="n")
    levels = {"jaar": ["jaar"], "status": ["jaar", "status"], "prioriteit": ["status", "prioriteit"]}
    return rollups_tagged(base, levels, "n")


@checked(
    "reconcile",
    f"""
    WITH l AS ({_LINES.sql}),
    t AS (SELECT 'vlag' AS dim, jaar, coalesce(sum(aantal), 0) AS n FROM l GROUP BY ALL
          UNION ALL SELECT 'status', jaar, coalesce(sum(aantal), 0) FROM l WHERE jaar < 2000 GROUP BY ALL
          UNION ALL SELECT 'nummer', jaar, coalesce(sum(aantal), 0) FROM l WHERE nummer < 7 OR jaar > 1996 GROUP BY ALL),
    w AS (SELECT jaar, CAST(max(n) FILTER (WHERE dim = 'vlag') AS BIGINT) AS vlag,
                 CAST(max(n) FILTER (WHERE dim = 'status') AS BIGINT) AS status,
                 CAST(max(n) FILTER (WHERE dim = 'nummer') AS BIGINT) AS nummer FROM t GROUP BY jaar)
    SELECT *, CAST(coalesce(vlag = status AND vlag = nummer, false) AS INTEGER) AS all_equal FROM w
    """,
)
def reconcile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted once at the finest level; the three breakdowns are roll-ups of that
    counted = group_sum(_LINES.read(spark, sf_dir), "jaar", "vlag", "status", "nummer", measure="aantal")
    base = settle(counted, "lines")
    breakdowns = rollups(
        base, {"vlag": ["jaar", "vlag"], "status": ["jaar", "status"], "nummer": ["jaar", "nummer"]}, "aantal"
    )
    breakdowns["status"] = breakdowns["status"].where("jaar < 2000")
    breakdowns["nummer"] = breakdowns["nummer"].where("nummer < 7 OR jaar > 1996")
    out = reconcile(breakdowns, "jaar", "aantal")
    return out.withColumn("all_equal", F.col("all_equal").cast("int"))


@checked(
    "total_preservation",
    """
    SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS total,
           (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS rows, 1 AS equal
    """,
)
def total_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))

    def counted(lines: DataFrame, orders: DataFrame) -> DataFrame:
        return group_count(lines.unionByName(orders), "status", name="Aantal")

    out = write_preserving({"lines": lines, "orders": orders}, counted, shared_dir(spark, "counted"), "Aantal")
    return out.withColumn("equal", F.col("equal").cast("int"))


@checked(
    "running_total_chunks",
    """
    WITH RECURSIVE y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS jaar, count(*) AS n FROM orders GROUP BY ALL),
    lim AS (SELECT CAST(floor(count(*) / 3) AS BIGINT) AS lim FROM orders),
    o AS (SELECT *, row_number() OVER (ORDER BY jaar DESC) AS rn, sum(n) OVER (ORDER BY jaar DESC) AS cum FROM y),
    f AS (
      SELECT jaar, n, rn, cum, CAST(n AS BIGINT) AS size, CAST(1 AS INTEGER) AS serie FROM o WHERE rn = 1
      UNION ALL
      SELECT o.jaar, o.n, o.rn, o.cum,
             CAST(CASE WHEN f.size + o.n > lim.lim THEN o.n ELSE f.size + o.n END AS BIGINT),
             CAST(CASE WHEN f.size + o.n > lim.lim THEN f.serie + 1 ELSE f.serie END AS INTEGER)
      FROM f JOIN o ON o.rn = f.rn + 1 CROSS JOIN lim)
    SELECT jaar, n, CAST(cum AS BIGINT) AS cum, CAST(cum AS BIGINT) AS lopend, serie FROM f
    """,
)
def running_total_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = group_count(orders, F.year("o_orderdate").alias("jaar"))
    limit = orders.count() // 3
    chunks = pack_years(counts, "jaar", "n", limit)
    return running_total(chunks, "jaar", "n", "lopend")


@checked(
    "distinct_per_year",
    """
    WITH d AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS Jaar, o_custkey, c_mktsegment AS seg
               FROM orders JOIN customer ON o_custkey = c_custkey),
    w AS (SELECT Jaar, count(*) FILTER (WHERE seg = 'AUTOMOBILE') AS AUTOMOBILE, count(*) FILTER (WHERE seg = 'BUILDING') AS BUILDING,
                 count(*) FILTER (WHERE seg = 'FURNITURE') AS FURNITURE, count(*) FILTER (WHERE seg = 'HOUSEHOLD') AS HOUSEHOLD,
                 count(*) FILTER (WHERE seg = 'MACHINERY') AS MACHINERY FROM d GROUP BY Jaar)
    SELECT *, AUTOMOBILE + BUILDING + FURNITURE + HOUSEHOLD + MACHINERY AS som FROM w
    """,
)
def distinct_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = (
        table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("Jaar"), "o_custkey").distinct()
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    joined = seen.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = contingency(joined, "Jaar", "seg", segments)
    return wide.withColumn("som", sum((F.col(s) for s in segments[1:]), F.col(segments[0])))
