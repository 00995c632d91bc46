"""A key that holds a third of all rows, and lookups too large to broadcast: same rows, sound plan."""

import pytest
from conftest import rows

from tabularium.operators import (
    attach,
    full_merge,
    group_count,
    keep_keys,
    last_per_group,
    left_lookup,
    missing_from,
    wide_count,
)
from tabularium.plans import casualties_by_road_type
from tabularium.sources import settle

HOT = 7


@pytest.fixture(scope="module")
def facts(spark):
    """30 000 rows; key 7 and the missing key hold a third each."""
    return spark.range(30_000).selectExpr(
        "id",
        f"CASE id % 3 WHEN 0 THEN {HOT} WHEN 1 THEN NULL ELSE cast(id % 1000 AS INT) END AS k",
        "cast(2000 + id % 2 AS INT) AS j",
    )


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffle"])
def threshold(spark, request):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, request.param)
    yield request.param
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.fixture(scope="module")
def expected(facts):
    counts = {}
    for r in facts.select("k").collect():
        counts[r["k"]] = counts.get(r["k"], 0) + 1
    return counts


def test_counts(facts, expected, threshold):
    assert dict(rows(group_count(facts, "k"))) == expected
    assert expected[HOT] >= 10_000 and expected[None] >= 10_000


def test_lookup_keeps_hot_and_missing_keys(spark, facts, expected, threshold):
    ref = spark.range(500).selectExpr("cast(id AS INT) AS code", "concat('l', id) AS label")
    out = left_lookup(facts, ref, {"k": "code"})
    got = dict(rows(group_count(out, "label")))
    assert got[f"l{HOT}"] == expected[HOT]
    assert got[None] == sum(n for k, n in expected.items() if k is None or k >= 500)
    assert sum(got.values()) == 30_000


def test_full_merge_keeps_everything_once(spark, facts, expected, threshold):
    few = spark.range(900, 1100).selectExpr("cast(id AS INT) AS k", "id AS w").unionByName(
        spark.sql("SELECT cast(NULL AS INT) AS k, 5L AS w")
    )
    out = full_merge(facts, few, "k")
    alone = 200 - len([k for k in expected if k is not None and k >= 900])
    assert out.count() == 30_000 + alone
    assert out.where("k IS NULL AND w = 5").count() == expected[None]
    assert out.where("id IS NULL").count() == alone


def test_membership(spark, facts, expected, threshold):
    keys = facts.where("k IS NULL OR k = 7").select("k")
    hot = expected[HOT] + expected[None]
    assert keep_keys(facts, keys, "k").count() == hot
    assert keep_keys(facts, settle(keys, "keys"), "k").count() == hot
    assert missing_from(facts, keys, "k").count() == 30_000 - hot


def test_last_row_of_a_hot_group(facts, threshold):
    got = dict(rows(last_per_group(facts, ["k"], ["id"], ["id"])))
    assert got[HOT] == max(i for i in range(30_000) if i % 3 == 0 or (i % 3 == 2 and i % 1000 == HOT))
    assert got[None] == max(i for i in range(30_000) if i % 3 == 1)


def test_wide_count_of_a_hot_group(facts, expected, threshold):
    wide = wide_count(facts, "k", period="j", periods=[2000, 2001])
    assert sum(v or 0 for r in wide.collect() for v in r[1:]) == 30_000
    hot = wide.where(f"k = {HOT}").first()
    assert hot["2000"] + hot["2001"] == expected[HOT]


def test_counting_per_accident_shuffles_the_events_once(spark, facts, capsys):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        casualties = facts.selectExpr("j AS jaar", "cast(k AS BIGINT) AS vornum", "0 AS ernstsl")
        types = spark.range(1000).selectExpr("cast(2000 + id % 2 AS INT) AS jaar", "id AS vornum", "concat('t', id % 3) AS wegtype")
        out = casualties_by_road_type(casualties, types, [2000, 2001])
        out.explain()
        plan = capsys.readouterr().out
        # one shuffle for the events, serving count and join, and one for the other side
        assert plan.count("hashpartitioning(jaar") == 1 and plan.count("hashpartitioning(_key_jaar") == 1
        assert sum(v or 0 for r in out.collect() for v in r[1:]) == 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_event_tables_join_without_a_shuffle(spark, capsys):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.range(300).selectExpr("id % 100 AS vornum", "if(id % 7 = 0, NULL, id % 3) AS wegbeh")
        accidents = spark.range(100).selectExpr("id AS vornum", "if(id % 7 = 0, NULL, id % 3) AS wegbeh", "id AS w")
        events.write.bucketBy(4, "vornum").saveAsTable("b_events")
        accidents.write.bucketBy(4, "vornum").saveAsTable("b_accidents")
        out = attach(spark.table("b_events"), spark.table("b_accidents").drop("wegbeh"), "vornum", null_safe=False)
        out.explain()
        assert "Exchange" not in capsys.readouterr().out
        assert out.where("w = vornum").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_partition_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for n, v in settings.items():
        spark.conf.set(n, v)
    try:
        facts = spark.range(0, 200_000, 1, 16).selectExpr(
            "id", f"if(id % 3 = 0, {HOT}, cast(id % 1000 AS INT)) AS k", "uuid() AS ballast"
        )
        other = spark.range(1000).selectExpr("cast(id AS INT) AS k", "id AS w")
        out = attach(facts, other, "k")
        assert len(out.collect()) == 200_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for n in settings:
            spark.conf.unset(n)
