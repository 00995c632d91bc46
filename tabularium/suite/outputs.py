"""Sinks and sheets: written, read back, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import append, group_count, pack_years
from ..sources import (
    chunk_summary,
    read_csv2,
    read_sheet,
    scan,
    shared_dir,
    sheet_table,
    tagged,
    write_chunks,
    write_csv2,
    write_dataset,
)
from .base import checked, table


_TEXT = "'zegt \"' || o_orderpriority || '\"; en'"


@checked(
    "csv2_roundtrip",
    f"""
    SELECT o_orderkey, CAST(nullif(o_custkey % 7, 0) AS INTEGER) AS code, o_totalprice AS bedrag,
           CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'a\\b\\n' WHEN 2 THEN 'twee' || chr(10) || 'regels' || chr(13) || chr(10) WHEN 3 THEN 'a' || chr(1) || 'b;' || chr(1)
                WHEN 4 THEN 'NA' WHEN 5 THEN '' ELSE {_TEXT} END AS tekst
    FROM orders
    """,
)
def csv2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (
        "CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN r'a\\b\\n' WHEN 2 THEN 'twee' || chr(10) || 'regels' || chr(13) || chr(10)"
        f" WHEN 3 THEN 'a' || chr(1) || 'b;' || chr(1) WHEN 4 THEN 'NA' WHEN 5 THEN '' ELSE {_TEXT} END AS tekst"
    )
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(nullif(o_custkey % 7, 0) AS INT) AS code", "o_totalprice AS bedrag", odd
    )
    path = shared_dir(spark, "csv2")
    write_csv2(rows, path)
    return read_csv2(spark, path, rows.schema)


@checked(
    "dataset_write",
    """
    SELECT 'status' AS tabel, o_orderstatus AS code, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'prioriteit', o_orderpriority, count(*) FROM orders GROUP BY ALL
    """,
)
def dataset_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    tables = {
        "status": group_count(orders, F.col("o_orderstatus").alias("code")),
        "prioriteit": group_count(orders, F.col("o_orderpriority").alias("code")),
    }
    paths = write_dataset(tables, shared_dir(spark, "dataset"))
    return append(*[tagged(scan(spark, path), tabel=name) for name, path in paths.items()])


@checked(
    "chunked_write",
    """
    WITH RECURSIVE y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS Jaar, count(*) AS n FROM lineitem GROUP BY ALL),
    lim AS (SELECT CAST(floor(count(*) / 3) AS BIGINT) AS lim FROM lineitem),
    o AS (SELECT *, row_number() OVER (ORDER BY Jaar DESC) AS rn FROM y),
    f AS (
      SELECT Jaar, n, rn, CAST(n AS BIGINT) AS size, CAST(1 AS INTEGER) AS serie FROM o WHERE rn = 1
      UNION ALL
      SELECT o.Jaar, o.n, o.rn, CAST(CASE WHEN f.size + o.n > lim.lim THEN o.n ELSE f.size + o.n END AS BIGINT),
             CAST(CASE WHEN f.size + o.n > lim.lim THEN f.serie + 1 ELSE f.serie END AS INTEGER)
      FROM f JOIN o ON o.rn = f.rn + 1 CROSS JOIN lim)
    SELECT serie, Jaar, n FROM f
    """,
)
def chunked_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("Jaar"), "l_orderkey", "l_quantity"
    )
    path = shared_dir(spark, "chunks")
    write_chunks(lines, path, limit=lines.count() // 3)
    return group_count(scan(spark, path), F.col("serie").cast("int").alias("serie"), "Jaar")


@checked(
    "chunk_summary",
    """
    WITH RECURSIVE y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS Jaar, count(*) AS n FROM lineitem GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (ORDER BY Jaar DESC) AS rn FROM y),
    f AS (
      SELECT Jaar, n, rn, CAST(n AS BIGINT) AS size, CAST(1 AS INTEGER) AS serie FROM o WHERE rn = 1
      UNION ALL
      SELECT o.Jaar, o.n, o.rn, CAST(CASE WHEN f.size + o.n > 20000 THEN o.n ELSE f.size + o.n END AS BIGINT),
             CAST(CASE WHEN f.size + o.n > 20000 THEN f.serie + 1 ELSE f.serie END AS INTEGER)
      FROM f JOIN o ON o.rn = f.rn + 1)
    SELECT serie, CAST(sum(n) AS BIGINT) AS rijen, min(Jaar) AS minY, max(Jaar) AS maxY FROM f GROUP BY serie
    """,
)
def chunk_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.year("l_shipdate").alias("Jaar")
    counts = group_count(table(spark, sf_dir, "lineitem"), years)
    return chunk_summary(pack_years(counts, limit=20_000))


@checked(
    "sheet_table",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS Jaar, count(*) AS orders, count(DISTINCT o_custkey) AS klanten FROM orders GROUP BY ALL
    """,
)
def sheet_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_customer = group_count(
        table(spark, sf_dir, "orders"), F.year("o_orderdate").alias("jaar"), "o_custkey"
    )
    yearly = per_customer.groupBy("jaar").agg(
        F.sum("n").alias("orders"), F.count(F.lit(1)).alias("klanten")
    )
    cells = yearly.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(yearly.columns, 1)])
    # the table stands between lines of text, as in an explanation sheet
    text = spark.sql(
        "SELECT * FROM VALUES ('Aantallen; \"per jaar\"', CAST(NULL AS STRING), CAST(NULL AS STRING)),"
        " (NULL, 'orders', 'klanten'), ('vanaf 1995', NULL, '1995') AS t(c1, c2, c3)"
    )
    path = shared_dir(spark, "sheet")
    write_csv2(text.unionByName(cells).toDF("...1", "...2", "...3"), path)
    return sheet_table(
        read_sheet(spark, path), [("Jaar", "int"), ("orders", "bigint"), ("klanten", "bigint")]
    )
