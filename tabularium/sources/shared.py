"""The folder every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``; without that setting there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result with a long history that is used more than once: the history runs once, a lost
    executor costs no recomputation, and the size of the result is known to the planner.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, changes: Mapping[str, str]) -> Iterator[None]:
    """Other settings for the jobs that run inside; what stood before stands again afterwards.

    A plan is optimised when its job starts, so the job has to run inside too (settle its result).
    """
    before = {name: spark.conf.get(name, None) for name in changes}
    try:
        for name, value in changes.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
