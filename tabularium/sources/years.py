"""Facts stored by year: written so, read by year, and brought up to date when reports come late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import group_sum
from ..operators.window import only_years
from .shared import settings, settle

DYNAMIC = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}
LEDGER = "_late"


def write_by_year(df: DataFrame, path: str, year: str, mode: str = "overwrite") -> None:
    """One folder per year (``jaar=1996`` ...), rows without a year in the default one.

    The rows of a year are gathered in few tasks, and a year that holds most rows is split over several again, so neither
    many small files nor one huge task comes out.
    """
    gathered = df.hint("rebalance", F.col(f"`{year}`"))
    gathered.write.mode(mode).partitionBy(year).parquet(path)


def read_by_year(
    spark: SparkSession, path: str, year: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """What :func:`write_by_year` wrote; folders outside ``first`` to ``last`` are not opened."""
    df = spark.read.parquet(path)
    bounds = [f"`{year}` {op} {int(y)}" for op, y in ((">=", first), ("<=", last)) if y is not None]
    return df.where(" AND ".join(bounds)) if bounds else df


def of_years(facts: DataFrame, chosen: DataFrame, year: str, wanted: str | None = None) -> DataFrame:
    """Facts of the years in a table of chosen years.

    An inner join on the folder column: Spark looks up the chosen years first and opens only their folders (dynamic
    partition pruning). ``wanted`` says which of the chosen years count. Years listed twice are taken once.
    """
    years = chosen.where(wanted) if wanted else chosen
    keys = years.selectExpr(f"`{year}` AS _year").distinct()
    joined = facts.join(F.broadcast(keys.where("_year BETWEEN 0 AND 9999")), F.expr(f"`{year}` = _year"))
    return joined.drop("_year")


def publish_counts(counts: DataFrame, path: str, year: str) -> None:
    """Counts stored by year, ready for :func:`merge_late`; no late reports are known yet."""
    write_by_year(counts, path, year)
    empty = counts.sparkSession.createDataFrame([], "batch string")
    empty.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{LEDGER}")


def merge_late(
    late: DataFrame, path: str, batch: str, keys: Sequence[str], measure: str, year: str
) -> DataFrame:
    """Add late counts to published ones; only the years they fall in are read and written again.

    ``late`` has the columns of the published table: the keys (the year among them) and the measure. The new totals of
    the touched years are settled before their folders are replaced, so nothing is lost when the job dies between. A
    ``batch`` that was merged before is refused, as its reports would count twice. Gives the touched years.
    """
    spark, ledger = late.sparkSession, f"{path.rstrip('/')}/{LEDGER}"
    if spark.read.schema("batch string").parquet(ledger).where(F.col("batch") == batch).count():
        raise ValueError(f"batch {batch!r} was merged before")
    delta = settle(group_sum(late, *keys, measure=measure), "late")
    touched = only_years(delta.select(year).distinct(), year)
    years = [r[0] for r in touched.collect()]  # calendar years, and those of rows without one
    published = spark.read.parquet(path)
    chosen = F.col(f"`{year}`").isin([y for y in years if y is not None])
    old = published.where(chosen | F.col(f"`{year}`").isNull() if None in years else chosen)
    columns = [*keys, measure]
    merged = group_sum(old.select(*columns).unionByName(delta.select(*columns)), *keys, measure=measure)
    merged = settle(merged.selectExpr(*[f"cast(`{c}` AS {published.schema[c].dataType.simpleString()}) AS `{c}`" for c in columns]), "merged")
    with settings(spark, DYNAMIC):
        write_by_year(merged, path, year)
    spark.createDataFrame([(batch,)], "batch string").write.mode("append").parquet(ledger)
    return touched
