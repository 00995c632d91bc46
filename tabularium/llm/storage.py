"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; without that setting there is no shared folder, and no path."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once and read back: later jobs start from files that outlive an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that may hold spaces, dots or backquotes, as it is written in an expression."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, whatever they are called."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def no_clash(df: DataFrame, *names: str) -> None:
    """An operator that adds columns cannot take a table that has them."""
    found = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if found:
        raise ValueError(f"columns exist: {sorted(found)}")
