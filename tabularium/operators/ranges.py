"""Running totals and ranks over any number of rows: range partitions and sums of what comes before each.

Rows are dealt to partitions by ranges of the order. Partition totals are added up in two steps, within stretches of
``STRETCH`` partitions and over the stretches, and a window inside each partition does the rest. No task sees more
than its own range, and the driver sees one number per stretch.

Spark sends the driver a few hundred sampled rows and a task's result for each range, so small ranges are made larger
beyond ``STRETCH`` of them: what the driver gets stays the same until ranges hold ``ROWS`` rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Store = Callable[[DataFrame, str], DataFrame]
STRETCH = 1024
ROWS = 1_000_000
PART, BEFORE = "_part", "_before"


def ranges_for(count: int, rows: int) -> int:
    """Ranges of about ``rows`` rows as far as ``STRETCH`` of them; beyond that larger ones, and more only from ``ROWS`` rows each on."""
    return max(1, min(-(-count // rows), max(STRETCH, -(-count // ROWS))))


def in_ranges(df: DataFrame, order: Sequence[Column], store: Store, rows: int) -> DataFrame:
    """``df`` stored in ranges of ``order`` of about ``rows`` rows, or more (see :func:`ranges_for`), numbered in ``_part``.

    Stored, because range bounds come from a sample and must not be drawn twice.
    """
    parts = ranges_for(df.count(), rows)
    if parts > STRETCH * STRETCH:
        raise ValueError(f"{parts} ranges; take more rows for each")
    return store(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def sums_before(ranged: DataFrame, total: str, kind: str = "bigint") -> DataFrame:
    """``(_part, _before)``: what ``total`` adds up to over all partitions before each."""
    sums = ranged.groupBy(PART).agg(F.expr(f"coalesce({total}, 0) AS _sum")).withColumn("_stretch", F.expr(f"{PART} div {STRETCH}"))
    heads, before, rows = sums.groupBy("_stretch").agg(F.sum("_sum").alias("n")), 0, []
    for r in sorted(heads.collect()):  # STRETCH numbers at most
        rows.append((r[0], before))
        before += r[1]
    heads = ranged.sparkSession.createDataFrame(rows, f"_stretch bigint, _head {kind}")
    earlier = Window.partitionBy("_stretch").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("_inside", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    return inside.join(F.broadcast(heads), "_stretch").select(PART, F.expr(f"cast(_head + _inside AS {kind}) AS {BEFORE}"))


def running_totals(
    counts: DataFrame, order: Sequence[Column], measure: str, store: Store, name: str = "cum", rows: int = 1_000_000
) -> DataFrame:
    """Running total of ``measure`` in ``order``, over as many groups as there are.

    The order has to tell all rows apart, else the total within ties follows no rule. Missing measures add nothing.
    The total is a long; one beyond it fails the job.
    """
    kept = counts.columns
    # counted once: rows are numbered, sampled for the bounds and dealt from what is stored
    ranged = in_ranges(store(counts, "groups"), order, store, rows)
    upto = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumn("_own", F.coalesce(F.sum(F.expr(f"cast(`{measure}` AS BIGINT)")).over(upto), F.lit(0)))
    # as many rows as ranges
    before = F.broadcast(sums_before(ranged, f"sum(cast(`{measure}` AS BIGINT))"))
    return own.join(before, PART).selectExpr(*[f"`{c}`" for c in kept], f"{BEFORE} + _own AS `{name}`")


def row_ranks(
    df: DataFrame, order: Sequence[Column], store: Store, name: str = "volgnr", rows: int = 1_000_000
) -> DataFrame:
    """``df`` with the place of every row in ``order``, from 1, without gaps.

    Rows that the order does not tell apart, however many, get places in the order in which they are stored; they too
    are spread over ranges. Rows are stored once before they are numbered, so a repeated task finds the same ones.
    """
    kept = df.columns
    numbered = store(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    full = [*order, F.col("_row")]
    ranged = in_ranges(numbered, full, store, rows)
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(PART).orderBy(*full)))
    before = F.broadcast(sums_before(ranged, "count(1)"))
    return own.join(before, PART).selectExpr(*[f"`{c}`" for c in kept], f"{BEFORE} + _own AS `{name}`")
