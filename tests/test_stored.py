"""Footers, years, late reports, observed totals, ranges, intervals, large key sets and text scans."""

import re

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from tabularium.operators import (
    group_count,
    interval_label,
    keep_many_keys,
    ranges,
    row_ranks,
    rollups,
    rollups_tagged,
    running_totals,
)
from tabularium.plans import population_cube, profile_catalog, profile_stored
from tabularium.plans.profile import footer_table, profile_table
from tabularium.sources import (
    FOOTERS,
    catalog_columns,
    column_table,
    footer_scan,
    merge_late,
    of_years,
    parameter_scan,
    publish_counts,
    read_by_year,
    settings,
    settle,
    sql_scan,
    statement,
    write_by_year,
    write_exact_chunks,
    write_preserving,
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan that ran, after adaptive execution."""
    df.collect()
    return plan_of(df)


# footers


def test_a_profile_of_stored_columns_reads_footers_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).selectExpr("cast(1990 + id % 30 AS INT) AS JAAR", "id AS ROWID", "cast(id AS STRING) AS tekst").write.parquet(path)
    with settings(spark, FOOTERS):
        one = profile_table("dbo", "t", footer_scan(spark, path))
        plan = plan_of(one)
        assert "PushedAggregation: [COUNT(*), MIN(JAAR), MAX(JAAR)]" in plan
        assert "ReadSchema: struct<count(*):bigint,min(JAAR):int,max(JAAR):int>" in plan
        assert rows(one) == [("dbo", "T", 1000, 2, 1990, 2019)]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_stored_profile_of_dates_missing_values_and_no_rows(spark, tmp_path):
    dates = spark.sql("SELECT date'2001-02-03' AS BEGDAT, CAST(NULL AS DATE) AS ENDDAT UNION ALL SELECT NULL, date'1999-01-01'")
    spark.sql("SELECT CAST(NULL AS INT) AS JAAR").write.parquet(f"{tmp_path}/missing")
    dates.write.parquet(f"{tmp_path}/dates")
    dates.limit(0).write.parquet(f"{tmp_path}/none")
    with settings(spark, FOOTERS):
        assert "MIN(BEGDAT)" in plan_of(profile_table("a", "d", footer_scan(spark, f"{tmp_path}/dates")))
    got = profile_stored(spark, {("a", name): f"{tmp_path}/{name}" for name in ("dates", "missing", "none")})
    assert rows(got) == [("a", "DATES", 2, 2, 2001, 2001), ("a", "MISSING", 1, 1, None, None), ("a", "NONE", 0, 2, None, None)]


def spoil(folder):
    """Overwrite the column data of parquet files, and leave their footers."""
    for f in folder.glob("*.parquet"):
        raw = bytearray(f.read_bytes())
        raw[4:200] = b"\xff" * 196
        f.write_bytes(raw)
    for crc in folder.glob(".*.crc"):
        crc.unlink()


def test_profiles_of_files_and_of_a_catalogue_need_no_column_data(spark, tmp_path):
    columns = "cast(1990 + id % 30 AS INT) AS JAAR", "id AS ROWID", "cast(id AS STRING) AS tekst"
    spark.range(2000).selectExpr(*columns).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.range(9).selectExpr("id AS a", *columns).write.partitionBy("JAAR").parquet(f"{tmp_path}/p")
    spark.range(3).write.json(f"{tmp_path}/j")
    spoil(tmp_path / "t")
    with pytest.raises(Exception):
        spark.read.parquet(f"{tmp_path}/t").agg({"ROWID": "max", "JAAR": "min", "tekst": "max"}).collect()
    assert rows(profile_stored(spark, {("a", "t"): f"{tmp_path}/t"})) == [("a", "T", 2000, 2, 1990, 2019)]
    spark.sql("CREATE DATABASE voeten LOCATION :p", {"p": f"{tmp_path}/db"})
    try:
        for name, kind in (("t", "parquet"), ("p", "parquet"), ("j", "json")):
            spark.catalog.createTable(f"voeten.{name}", f"{tmp_path}/{name}", kind)
        spark.sql("MSCK REPAIR TABLE voeten.p") if spark.table("voeten.p").count() == 0 else None
        got = rows(profile_catalog(spark, ["voeten"]).drop("error"))
        assert got == [("voeten", "J", 3, 1, None, None), ("voeten", "P", 9, 3, 1990, 1998), ("voeten", "T", 2000, 2, 1990, 2019)]
        assert footer_table(spark, "voeten.j") is None and footer_table(spark, "voeten.p") is None
    finally:
        spark.sql("DROP DATABASE voeten CASCADE")


# totals observed while writing


def counted(lines, orders):
    return group_count(lines.unionByName(orders), "k", name="Aantal")


def test_the_writing_job_checks_its_own_total(spark, frame, tmp_path):
    inputs = {"lines": frame("k int", (1,), (2,), (None,)), "orders": frame("k int", (1,))}
    assert rows(write_preserving(inputs, counted, f"{tmp_path}/out", "Aantal")) == [(4, 4, True)]
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(None, 1), (1, 2), (2, 1)]
    lost = write_preserving(inputs, lambda lines, orders: counted(lines.where("k = 1"), orders), f"{tmp_path}/lost", "Aantal")
    assert rows(lost) == [(2, 4, False)]
    empty = {name: df.limit(0) for name, df in inputs.items()}
    assert rows(write_preserving(empty, counted, f"{tmp_path}/empty", "Aantal")) == [(0, 0, True)]


def test_no_input_is_scanned_a_second_time(spark, tmp_path):
    inputs = {n: spark.read.parquet(f"{SMALL}/{n}.parquet").selectExpr(f"{c} AS k") for n, c in (("lineitem", "l_linenumber"), ("orders", "o_custkey"))}
    group = "observed-write"
    spark.sparkContext.setJobGroup(group, "one job")
    try:
        write_preserving({"lines": inputs["lineitem"], "orders": inputs["orders"]}, counted, f"{tmp_path}/out", "Aantal")
        tracker = spark.sparkContext.statusTracker()
        scans = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # a map stage for each input, and the stage that adds up and writes (adaptive execution submits it anew)
    assert len(scans) <= 5


def test_a_repeated_count_is_counted_again(spark, frame, tmp_path, monkeypatch):
    from tabularium.sources import observed

    class Doubled(observed.Observation):
        @property
        def get(self):
            return {"n": 2 * super().get["n"]} if self._name.startswith("rows") else super().get

    monkeypatch.setattr(observed, "Observation", Doubled)
    inputs = {"lines": frame("k int", (1,), (2,)), "orders": frame("k int", (1,))}
    assert rows(write_preserving(inputs, counted, f"{tmp_path}/out", "Aantal")) == [(3, 3, True)]


# roll-ups in one pass

LEVELS = {"a": ["a"], "ab": ["a", "b"], "b": ["b"], "alles": [], "nog eens": ["b", "a"]}


def test_rollups_in_one_pass_tell_missing_keys_from_rolled_up_ones(frame):
    base = frame("a int, b string, n bigint", (1, "x", 2), (1, None, 3), (None, "x", 5), (None, None, 7), (1, "x", None))
    got = rollups_tagged(base, LEVELS, "n")
    apart = rollups(base, {k: v for k, v in LEVELS.items() if v}, "n")
    want = [(tag, r["a"] if "a" in by else None, r["b"] if "b" in by else None, r["n"]) for tag, by in LEVELS.items() if by for r in apart[tag].collect()]
    assert rows(got) == sorted([*want, ("alles", None, None, 17)], key=lambda r: [(v is not None, str(v)) for v in r])
    plan = plan_of(got)
    assert plan.split("Initial Plan")[-1].count("Expand") == 1 and plan.split("Initial Plan")[-1].count("Exchange") == 1
    stored = rollups(base, LEVELS, "n", store=settle)
    assert {k: rows(v) for k, v in stored.items() if k in apart} == {k: rows(v.select(*stored[k].columns)) for k, v in apart.items()}


def test_population_cube_is_one_aggregate_over_the_base(spark):
    from tabularium.plans.population import HISTORIC, RECENT, REGION

    columns = list(dict.fromkeys([*HISTORIC, *RECENT, *REGION, "lft_inw"]))
    base = spark.range(4).selectExpr(*[f"CAST(NULL AS INT) AS {c}" for c in columns], "id AS Inwoners")
    cube = population_cube(base)
    assert plan_of(cube).count("Expand") == 1
    assert {r.tabel: r.Inwoners for r in cube.collect()} == dict.fromkeys(["Gemeenten_historisch", "Gemeenten_recent_lft_sex", "Inwoners_regio_leeftijd"], 6)


# years


@pytest.fixture()
def by_year(spark, tmp_path):
    df = spark.range(600).selectExpr("cast(if(id % 50 = 0, NULL, 1990 + id % 6) AS INT) AS jaar", "id", "id % 4 AS k")
    write_by_year(df, f"{tmp_path}/years", "jaar")
    return f"{tmp_path}/years", df


def test_year_folders_outside_the_bounds_are_not_opened(spark, by_year):
    path, df = by_year
    some = read_by_year(spark, path, "jaar", 1991, 1992)
    assert re.search(r"PartitionFilters: \[isnotnull\(jaar#\d+\), \(jaar#\d+ >= 1991\), \(jaar#\d+ <= 1992\)\]", plan_of(some))
    assert len({f for f in some.inputFiles() if "jaar=" in f}) >= 2
    assert rows(some, "id") == rows(df.where("jaar IN (1991, 1992)"), "id")
    assert rows(read_by_year(spark, path, "jaar"), "jaar", "id") == rows(df, "jaar", "id")


def test_the_series_by_year_prunes_both_sources(spark):
    from tabularium.suite import QUERIES

    plan = plan_of(QUERIES["two_periods_by_year"](spark, SMALL))
    assert re.search(r"PartitionFilters: \[isnotnull\(jaar#\d+\), \(jaar#\d+ >= 1987\)\]", plan)
    assert re.search(r"PartitionFilters: \[isnotnull\(Jaar#\d+\), \(Jaar#\d+ < 1987\)\]", plan)


def test_chosen_years_prune_folders_at_run_time(spark, frame, by_year):
    path, df = by_year
    chosen = settle(frame("jaar int, n int", (1990, 1), (1991, 2), (1991, 2), (1993, 3), (None, 4), (2050, 9)), "chosen")
    facts = of_years(read_by_year(spark, path, "jaar"), chosen, "jaar", "n >= 2")
    assert "dynamicpruning" in plan_of(facts)
    assert rows(facts, "id") == rows(df.where("jaar IN (1991, 1993)"), "id")


def test_late_counts_rewrite_their_years_only(spark, frame, tmp_path):
    path, keys = f"{tmp_path}/counts", ["jaar", "k"]
    start = frame("jaar int, k string, n bigint", (1992, "a", 5), (1992, "b", 1), (1993, "a", 2), (1994, "a", 9), (None, "a", 3))
    publish_counts(start, path, "jaar")
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "counts").rglob("jaar=*/*.parquet")}
    before = files()
    late = frame("k string, n bigint, jaar int", ("a", 40, 1992), ("c", 2, 1992), ("a", 1, 1995), (None, 1, 1993), (None, 1, 1993))
    assert rows(merge_late(late, path, "nr 1", keys, "n", "jaar")) == [(1992,), (1993,), (1995,)]
    want = [(None, "a", 3), (1992, "a", 45), (1992, "b", 1), (1992, "c", 2), (1993, None, 2), (1993, "a", 2), (1994, "a", 9), (1995, "a", 1)]
    assert rows(spark.read.parquet(path), "jaar", "k", "n") == want
    same = {f for f, t in before.items() if files().get(f) == t}
    assert all("jaar=1994" in f or "HIVE_DEFAULT" in f for f in same) and len(same) == 2
    with pytest.raises(ValueError, match="merged before"):
        merge_late(late, path, "nr 1", keys, "n", "jaar")
    merge_late(frame("jaar int, k string, n bigint", (None, "a", 1)), path, "nr 2", keys, "n", "jaar")
    assert (None, "a", 4) in rows(spark.read.parquet(path), "jaar", "k", "n")
    merge_late(late.limit(0), path, "nr 3", keys, "n", "jaar")
    assert spark.read.parquet(path).count() == len(want)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static").lower() == "static"


# running totals and ranks


def test_running_totals_of_many_groups(spark):
    counts = spark.range(200_000).selectExpr("cast(reverse(cast(id AS STRING)) AS BIGINT) * 1000000 + id AS g", "if(id % 7 = 0, NULL, id % 11) AS n")
    got = running_totals(counts, [F.col("g").desc()], "n", settle, rows=9000)
    plan = plan_of(got)
    # every window has a partition: a range, or a stretch of them
    windows = re.findall(r"windowspecdefinition\((\w+)#", plan)
    assert windows and set(windows) <= {"_part", "_stretch"}
    total = 0
    for g, n, cum in sorted(got.collect(), reverse=True):
        total += n or 0
        assert cum == total
    assert got.count() == 200_000
    assert running_totals(counts.limit(0), [F.col("g")], "n", settle).count() == 0


def test_ranks_have_no_gaps_where_one_key_holds_most_rows(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 > 0, 7, id) AS k", "if(id % 5 = 0, NULL, 'x') AS t")
    got = row_ranks(df, [F.col("k").asc_nulls_last()], settle, rows=1000)
    ranked = sorted(got.collect(), key=lambda r: r.volgnr)
    assert [r.volgnr for r in ranked] == list(range(1, 30_001))
    assert [r.k for r in ranked] == sorted(r.k for r in ranked)
    # the hot key is spread: no range holds much more than its share
    stored = spark.read.parquet(re.search(r"(/\S*ranges-[0-9a-f]+)", got.inputFiles()[0])[1])
    assert stored.groupBy("_part").count().agg(F.max("count")).first()[0] < 4000


def test_small_ranges_grow_instead_of_their_number(spark, monkeypatch):
    assert [ranges.ranges_for(n, 2000) for n in (0, 1, 2001, 2_048_000, 2_048_001, 216_000_000, 1_024_000_000)] == [1, 1, 2, 1024, 1024, 1024, 1024]
    assert ranges.ranges_for(5_000_000_000, 2000) == 5000 and ranges.ranges_for(5_000_000_000, 10_000_000) == 500
    monkeypatch.setattr(ranges, "STRETCH", 4)
    df = spark.range(6000).selectExpr("if(id % 3 > 0, 7, id) AS k")
    for most, parts in ((10_000, 4), (600, 10)):  # within one stretch, over three of them
        monkeypatch.setattr(ranges, "ROWS", most)
        got = row_ranks(df, [F.col("k").desc()], settle, rows=100)
        stored = spark.read.parquet(re.search(r"(/\S*ranges-[0-9a-f]+)", got.inputFiles()[0])[1])
        assert stored.agg(F.max("_part")).first()[0] == parts - 1
        ranked = sorted(got.collect(), key=lambda r: r.volgnr)
        assert [r.volgnr for r in ranked] == list(range(1, 6001))
        assert [r.k for r in ranked] == sorted((r.k for r in df.collect()), reverse=True)
        totals = running_totals(spark.range(6000).selectExpr("id AS g", "id % 5 AS n"), [F.col("g")], "n", settle, rows=100)
        assert [r.cum for r in sorted(totals.collect())] == [sum(range(5)) * (g // 5) + sum(range(g % 5 + 1)) for g in range(6000)]


def test_exact_chunks(spark, tmp_path):
    df = spark.range(10_007).selectExpr("cast(if(id % 3 > 0, 2020, 2000 + id % 20) AS INT) AS Jaar", "id")
    path = f"{tmp_path}/chunks"
    write_exact_chunks(df, path, [F.col("Jaar").desc_nulls_last()], limit=1000, rows=700)
    sizes = {r.serie: (r.n, r.a, r.b) for r in spark.read.parquet(path).groupBy("serie").agg(F.expr("count(1) AS n"), F.expr("min(volgnr) AS a"), F.expr("max(volgnr) AS b")).collect()}
    assert sizes == {s: (1000, 1000 * (s - 1) + 1, 1000 * s) for s in range(1, 11)} | {11: (7, 10_001, 10_007)}
    years = [r.Jaar for r in spark.read.parquet(path).orderBy("volgnr").collect()]
    assert years == sorted(years, reverse=True)
    assert rows(spark.read.parquet(path), "id") == rows(df, "id")


def test_exact_chunks_of_few_large_ranges(spark, tmp_path, monkeypatch):
    from tabularium.sources import sinks

    kept = []
    monkeypatch.setattr(sinks, "settle", lambda df, name: kept.append(settle(df, name)) or kept[-1])
    monkeypatch.setattr(ranges, "STRETCH", 4)
    df = spark.range(5003).selectExpr("cast(if(id % 3 > 0, 2020, if(id % 7 = 0, NULL, 2000 + id % 20)) AS INT) AS Jaar", "id")
    path = f"{tmp_path}/chunks"
    write_exact_chunks(df, path, [F.col("Jaar").desc_nulls_last()], limit=1000, rows=100)
    assert [r._part for r in kept[-1].select("_part").distinct().orderBy("_part").collect()] == [0, 1, 2, 3]
    got = spark.read.parquet(path).orderBy("volgnr").collect()
    assert [(r.volgnr, r.serie) for r in got] == [(i + 1, i // 1000 + 1) for i in range(5003)]
    assert [r.Jaar or 0 for r in got] == sorted((r.Jaar or 0 for r in got), reverse=True)
    assert rows(spark.read.parquet(path), "id", "Jaar") == rows(df, "id", "Jaar")


# intervals

RANGES = [(0, 14, "jong"), (15, 15, "vijftien"), (16, 120, "ouder")]


def test_interval_label_equals_the_case_form(spark, frame):
    ranges = frame("lo int, hi int, label string", *RANGES)
    df = spark.range(-3, 130).selectExpr("cast(id AS INT) AS x").unionByName(frame("x int", (None,), (32760,)))
    got = interval_label(df, "x", ranges, "klasse", otherwise="cast(x AS STRING)")
    case = "CASE " + " ".join(f"WHEN x BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in RANGES) + " ELSE cast(x AS STRING) END AS klasse"
    assert rows(got) == rows(df.selectExpr("x", case))
    assert not re.search("NestedLoop|Cartesian|Join", plan_of(got))


@pytest.mark.parametrize(
    "ranges, message",
    [([(0, 5, "a"), (5, 9, "b")], "overlap"), ([(0, 5, "a"), (7, 9, "b")], "gap"), ([(5, 0, "a")], "swapped"), ([(None, 3, "a")], "without bounds")],
)
def test_wrong_tables_of_ranges_fail_the_job(frame, ranges, message):
    with pytest.raises(Exception, match=message):
        interval_label(frame("x int", (1,)), "x", frame("lo int, hi int, label string", *ranges), "k").collect()


def test_gaps_and_empty_tables_of_ranges(frame):
    some = frame("lo int, hi int, label string", (0, 5, "a"), (7, 9, "b"))
    values = frame("x int", (5,), (6,), (7,), (10,), (-1,))
    assert rows(interval_label(values, "x", some, "k", gaps=True)) == [(-1, None), (10, None), (5, "a"), (6, None), (7, "b")]
    assert rows(interval_label(values, "x", some.limit(0), "k", otherwise="'?'"), "k") == [("?",)] * 5


# large key sets


def test_large_key_sets_filter_before_the_shuffle(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS k", "id % 5 AS v").write.parquet(f"{tmp_path}/facts")
    facts, keys = spark.read.parquet(f"{tmp_path}/facts"), spark.range(20_000).selectExpr("id AS s").where("s % 50 = 3")
    forced = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    with settings(spark, forced):
        kept = keep_many_keys(facts, keys, {"k": "s"}, settle)
        plan = final_plan(kept)
        assert "might_contain" in plan and "LeftSemi" in plan
        assert "GreaterThanOrEqual(k,3)" in plan  # the scan skips row groups outside the keys
        assert rows(kept) == rows(facts.where("k % 50 = 3"))


def test_many_keys_with_missing_ones(spark, frame):
    df = frame("a int, b string", (1, "x"), (1, None), (None, "x"), (None, None), (2, "x"), (1, "x"))
    keys = frame("a int, b string", (1, "x"), (None, "x"), (1, None), (9, "q"))
    assert rows(keep_many_keys(df, keys, ["a", "b"], settle)) == [(None, "x"), (1, None), (1, "x"), (1, "x")]
    assert rows(keep_many_keys(df, keys.limit(0), ["a", "b"], settle)) == []
    assert rows(keep_many_keys(df, keys.where("b = 'x' AND a = 1"), ["a", "b"], settle)) == [(1, "x"), (1, "x")]


# text scans and column lists

ODD = "it's \"x\" \\ :v0 {y} `z` -- '"


def test_values_are_bound_and_never_part_of_the_text(spark, frame):
    df = frame("`a b` string, `c``d` int", (ODD, 1), ("x", 2), (None, 3))
    tests = [("a b", "=", ODD), ("c`d", "in", 1, 2), ("c`d", "between", 0, 9), ("a b", "is not null")]
    text, values, frames = statement(df, {"n": "c`d", "nog `eens`": "a b"}, tests)
    assert ODD not in text and ODD in values.values() and set(frames) == {"source"}
    got = parameter_scan(spark, df, {"n": "c`d", "nog `eens`": "a b"}, tests)
    assert got.columns == ["n", "nog `eens`"] and rows(got) == [(1, ODD)]
    assert rows(parameter_scan(spark, df, ["c`d"], [("c`d", "IN")])) == []
    with pytest.raises(ValueError, match="operator"):
        statement(df, ["a b"], [("a b", "= 'x' OR 1 =", 1)])


def test_scan_of_a_named_table(spark):
    spark.range(5).createOrReplaceTempView("v_statement")
    assert rows(parameter_scan(spark, "v_statement", ["id"], [("id", ">=", 3)])) == [(3,), (4,)]
    assert rows(sql_scan(spark, "SELECT IDENTIFIER(:c) AS x FROM IDENTIFIER(:t) WHERE id < :n", {"c": "id", "t": "v_statement", "n": 1})) == [(0,)]


def test_columns_of_tables_and_of_a_catalogue(spark, frame, tmp_path):
    df = frame("b int, `A x` string", (1, "a"))
    assert rows(column_table(spark, {"t": df})) == [("t", "A x", 2), ("t", "b", 1)]
    spark.sql("CREATE DATABASE kolommen LOCATION :p", {"p": f"{tmp_path}/db"})
    try:
        df.write.parquet(f"{tmp_path}/wegtabel")
        spark.catalog.createTable("kolommen.wegtabel", f"{tmp_path}/wegtabel", "parquet")
        spark.catalog.createTable("kolommen.anders", f"{tmp_path}/wegtabel", "parquet")
        assert rows(catalog_columns(spark, ["kolommen"], "weg")) == [("wegtabel", "A x", 2, "kolommen"), ("wegtabel", "b", 1, "kolommen")]
        assert catalog_columns(spark, ["kolommen"]).count() == 4
    finally:
        spark.sql("DROP DATABASE kolommen CASCADE")


def test_the_catalogue_of_the_profile_is_gone_afterwards(spark):
    from tabularium.suite import QUERIES

    before = {d.name for d in spark.catalog.listDatabases()}
    assert QUERIES["catalogue_profile"](spark, SMALL).count() == 14
    assert {d.name for d in spark.catalog.listDatabases()} == before
