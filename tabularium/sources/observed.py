"""Totals that are counted while a result is written."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.aggregate import same_total, total


def write_preserving(
    inputs: Mapping[str, DataFrame],
    build: Callable[..., DataFrame],
    path: str,
    measure: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> DataFrame:
    """Write ``build(**inputs)`` and check that its measure adds up to the number of input rows.

    Gives one row ``(total, rows, equal)``, see :func:`same_total`. The rows of every input and the total of the output are
    observed in the job that writes, so no input is read a second time. A task that runs twice, because an
    executor was lost, may count twice: when the numbers differ or one is missing, they are counted again from the
    inputs and from the written files before they are reported.
    """
    counted = {name: Observation(f"rows of {name}") for name in inputs}
    summed = Observation("total")
    watched = {name: df.observe(counted[name], F.count(F.lit(1)).alias("n")) for name, df in inputs.items()}
    out = build(**watched).observe(summed, F.expr(f"cast({total(measure)} AS BIGINT) AS n"))
    out.write.mode(mode).format(fmt).save(path)
    spark = out.sparkSession
    rows = [_seen(o) for o in counted.values()]
    adds_up = _seen(summed)
    if adds_up is None or None in rows or sum(rows) != adds_up:
        return same_total(spark.read.format(fmt).schema(out.schema).load(path), measure, *inputs.values())
    return spark.createDataFrame([(adds_up, sum(rows), True)], "total bigint, rows bigint, equal boolean")


def _seen(observation: Observation) -> int | None:
    """What was counted; None where the optimiser found a part of the plan to be empty, which then reports nothing."""
    try:
        return observation.get.get("n")
    except Py4JJavaError:
        return None
