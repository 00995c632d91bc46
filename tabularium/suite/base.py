"""Registering a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import scan

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def checked(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same query for the SQL engine, None when there is none."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class StandIn:
    """A test table dressed as a source table.

    Column expressions are SQL text that both engines read alike; where they differ, a pair
    ``(spark, sql)`` is given.
    """

    table: str
    columns: dict[str, str | tuple[str, str]]

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        exprs = [f"{e if isinstance(e, str) else e[0]} AS `{c}`" for c, e in self.columns.items()]
        return table(spark, sf_dir, self.table).selectExpr(*exprs)

    @property
    def sql(self) -> str:
        exprs = [f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in self.columns.items()]
        return f"SELECT {', '.join(exprs)} FROM {self.table}"


def round1_sql(x: str) -> str:
    """One decimal, nearest of the two neighbours, ties to the even one."""
    lo, hi = f"(floor({x} * 10) / 10)", f"(ceil({x} * 10) / 10)"
    return (
        f"(CASE WHEN {x} - {lo} < {hi} - {x} THEN {lo} WHEN {x} - {lo} > {hi} - {x} THEN {hi}"
        f" WHEN floor({x} * 10)::BIGINT % 2 = 0 THEN {lo} ELSE {hi} END)"
    )
