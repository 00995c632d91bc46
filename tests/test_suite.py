"""Every checked query against its SQL, and the shape of its physical plan."""

import os
import re

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
from tabularium.suite import ORACLES, QUERIES

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def comparable(table):
    return sorted([tuple("NULL" if v is None else repr(v) for v in row) for row in table])


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE wanted AS {ORACLES[name]}")
    types = {r[0]: r[1] for r in duck.execute("DESCRIBE wanted").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    listed = ", ".join(f'"{c}"' for c in columns)
    wanted = duck.execute(f"SELECT {listed} FROM wanted").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert got and comparable(got) == comparable(wanted)


@pytest.mark.parametrize("name", QUERIES)
def test_plan_has_no_pairing_python_or_whole_table_window(spark, capsys, name):
    QUERIES[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert not re.search("CartesianProduct|BroadcastNestedLoop|PythonUDF|ArrowEval|MapInPandas", plan)
    # windows are taken over years and months, or inside ranges
    assert ("Window" in plan) == (name in {"ordered_rows", "running_total_chunks", "running_total_groups", "row_places"})


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry_gives_rows(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert df.schema == entry_points.entry(spark).schema
