import glob
import os

import pytest
from conftest import SMALL, rows

from tabularium.sources import (
    csv2_columns,
    column_list,
    read_csv2,
    read_sheet,
    scan,
    settle,
    chunk_summary,
    settings,
    shared_dir,
    sheet_table,
    table_list,
    tagged,
    write_chunks,
    write_csv2,
    write_dataset,
    year_range,
)

# Published road deaths per year, true and registered.
DEATHS = {
    1996: (1251, 1180), 1997: (1235, 1163), 1998: (1149, 1066), 1999: (1186, 1090), 2000: (1166, 1082),
    2001: (1083, 993), 2002: (1066, 987), 2003: (1088, 1028), 2004: (881, 804), 2005: (817, 750),
    2006: (811, 730), 2007: (791, 709), 2008: (750, 677), 2009: (720, 644), 2010: (640, 537),
    2011: (661, 546), 2012: (650, 562), 2013: (570, 476), 2014: (570, 476), 2015: (621, 531),
    2016: (629, 533), 2017: (613, 535), 2018: (678, 598), 2019: (661, 586), 2020: (610, 515),
    2021: (582, 509), 2022: (745, 655), 2023: (684, 608), 2024: (675, 566),
}
# Registered deaths of the same years by transport mode.
DEATHS_BY_MODE = [10032, 1702, 4795, 1812, 459, 2101, 235]


def text_of(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_scan_pushes_columns_and_predicate(spark, capsys):
    df = scan(
        spark,
        f"{SMALL}/orders.parquet",
        columns={"a": "o_orderkey", "b": "o_orderkey"},
        where=f"{year_range('o_orderdate', 1996, 1997)} AND o_orderstatus = 'F'",
    )
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert df.columns == ["a", "b"]
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan and "o_custkey" not in plan


def test_scan_reads_a_catalogue_table(spark):
    spark.range(3).createOrReplaceTempView("v_scan")
    assert rows(scan(spark, table="v_scan", where="id > 0", columns=["id"])) == [(1,), (2,)]


def test_tags_are_literals(frame):
    assert rows(tagged(frame("a int", (1,)), Jaar=1992, pv="it's")) == [(1, 1992, "it's")]


def test_catalogue_lists(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS metadata")
    spark.sql("CREATE TABLE metadata.bron_weg (jaar INT, RowId INT) USING parquet")
    spark.sql("CREATE TABLE metadata.overig (a INT) USING parquet")
    assert ("bron_weg", "metadata", "BRON_WEG") in rows(table_list(spark, ["metadata"]))
    assert rows(table_list(spark, ["metadata"], containing="weg"), "dmx_naam") == [("BRON_WEG",)]
    assert column_list(spark.table("metadata.bron_weg")) == ["JAAR", "ROWID"]


def test_csv2_text(frame, tmp_path):
    df = frame(
        "i int, d double, t string",
        (1, 2.0, 'zegt "x"; y'),
        (2, 2.5, None),
        (None, None, "twee\nregels"),
    ).coalesce(1)
    path = f"{tmp_path}/csv2"
    write_csv2(df, path)
    assert text_of(path) == '"i";"d";"t"\n1;2;"zegt ""x""; y"\n2;2,5;NA\nNA;NA;"twee\nregels"\n'
    assert rows(read_csv2(frame("x int").sparkSession, path, df.schema)) == rows(df)


def test_csv2_keeps_numbers_and_spaces(frame, spark, tmp_path):
    df = frame("d double, t string", (0.1, " 0- 5 jaar"), (-12345.678, ""), (1e-7, "Fryslân"), (123456789.0, "x "))
    path = f"{tmp_path}/csv2"
    write_csv2(df, path)
    assert rows(read_csv2(spark, path, "d double, t string")) == rows(df)
    assert '"d";"t"\n123456789;"x "\n' in text_of(path) and '0,0000001;"Fryslân"' in text_of(path)
    assert '-12345,678;""' in text_of(path)


@pytest.mark.parametrize("x, text", [(84.25, "84,25"), (100.0, "100"), (1e5, "100000"), (2.5e21, "2500000000000000000000"), (0.1 + 0.2, "0,30000000000000004"), (0.0, "0")])
def test_csv2_number_text(frame, x, text):
    assert csv2_columns(frame("x double", (x,))).first()["x"] == text
    assert csv2_columns(frame("x double", (-x,)).selectExpr("x + 0D AS x")).first()["x"].lstrip("-") == text


def test_published_totals_come_out_of_a_sheet(spark, tmp_path):
    lines = ['"...1";"...2";"...3";"...4";"...5"', '"Totals; by year";NA;NA;NA;NA', 'NA;"True";"Reported";"Rate";NA']
    lines += [f'"{y}";"{true}";"{seen}";"{seen / true!r}";NA' for y, (true, seen) in DEATHS.items()]
    lines += ['"In the years 2012 -2016";NA;NA;NA;NA', "NA;NA;NA;NA;NA"]
    path = tmp_path / "sheet.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    sheet = read_sheet(spark, str(path))
    assert sheet.count() == len(lines) - 1 and len(sheet.columns) == 5
    totals = sheet_table(sheet, [("Jaar", "int"), ("echt", "int"), ("gemeld", "int"), ("graad", "double")])
    got = rows(totals)
    assert len(got) == 29
    assert sum(r[2] for r in got) == 21136 == sum(DEATHS_BY_MODE)
    assert sum(r[1] for r in got) == 23583
    assert all(abs(r[2] / r[1] - r[3]) < 1e-12 for r in got)


def test_dataset_formats(frame, spark, tmp_path):
    tables = {"A": frame("x int", (1,)), "B": frame("y double", (1.5,)).coalesce(1)}
    paths = write_dataset(tables, str(tmp_path / "p"))
    assert rows(scan(spark, paths["A"])) == [(1,)]
    paths = write_dataset(tables, str(tmp_path / "c"), fmt="csv2")
    assert text_of(paths["B"]) == '"y"\n1,5\n'


def test_csv2_text_is_kept_as_it_is(frame, spark, tmp_path):
    texts = ["NA", "", ";", '"', '""', '";"', "a\\nb", "a\nb\r\nc", "\\", "d;e", "#x", "a\x01b", "a\0b", "a\\\\b", "\n", "\r", " ", 'a"";"b', None, '"' * 50_000, "y" * 3_000_000, "x" * 30_000 + '"' * 2_000]
    df = frame("i int, t string, u string", *[(i, t, texts[-1 - i]) for i, t in enumerate(texts)]).repartition(3)
    path = f"{tmp_path}/csv2"
    write_csv2(df, path)
    assert rows(read_csv2(spark, path, df.schema)) == rows(df)
    plain = df.where("NOT contains(t, '\\n') AND NOT contains(u, '\\n')")
    write_csv2(plain, path)
    assert rows(read_csv2(spark, path, df.schema, line_breaks=False)) == rows(plain)


def test_csv2_of_other_writers(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_bytes('"Jaar";"graad";"naam";"NA"\n2001;0,5;"a\\b ""q"" \r\nregel; 2";NA\n2002;NA;"NA";"x"\n2003;1e+05;"";""\n'.encode())
    want = [(2001, 0.5, 'a\\b "q" \r\nregel; 2', None), (2002, None, "NA", "x"), (2003, 100000.0, "", "")]
    assert rows(read_csv2(spark, str(path), "Jaar int, graad double, naam string, x string")) == want
    lines = tmp_path / "lines"
    lines.mkdir()
    for part in range(3):
        (lines / f"{part}.csv").write_bytes(b'"k";"t"\n' + b"".join(b'%d;"k"\n' % i for i in range(part * 5000)))
    with_small_splits = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    with settings(spark, with_small_splits):
        got = read_csv2(spark, str(lines), "k int, t string", line_breaks=False)
        assert got.count() == 15_000 and got.rdd.getNumPartitions() > 3 and got.where("t != 'k'").count() == 0
    assert read_csv2(spark, str(lines), "k int, t string").count() == 15_000


def test_csv2_of_an_empty_table(spark, frame, tmp_path):
    write_csv2(frame("a int, t string", (1, "x")).limit(0), f"{tmp_path}/none")
    assert read_csv2(spark, f"{tmp_path}/none", "a int, t string").count() == 0


def test_csv2_keeps_all_digits_of_decimals(spark, tmp_path):
    df = spark.sql(
        "SELECT cast('12345678.123456789012345678' AS DECIMAL(38,18)) AS a, cast('0.12345678901234567890123456789012345678' AS DECIMAL(38,38)) AS b,"
        " cast('0' AS DECIMAL(38,18)) AS c, cast('-0.000000000000000001' AS DECIMAL(38,18)) AS d, cast(1200 AS DECIMAL(10,0)) AS e, cast(NULL AS DECIMAL(9,2)) AS f"
    )
    path = f"{tmp_path}/csv2"
    write_csv2(df, path)
    assert rows(read_csv2(spark, path, df.schema)) == rows(df)
    assert "12345678,123456789012345678;0,12345678901234567890123456789012345678;0;-0,000000000000000001;1200;NA" in text_of(path)


def test_chunk_summary(spark, frame):
    chunks = frame("Jaar int, n bigint, serie int", (2003, 5, 1), (2002, 6, 1), (None, 1, 2))
    assert rows(chunk_summary(chunks)) == [(1, 11, 2002, 2003), (2, 1, None, None)]


def test_chunks_hold_whole_years_under_the_limit(spark, tmp_path):
    sizes = {2000: 40, 2001: 50, 2002: 30, 2003: 30, 1999: 250, None: 5}
    parts = [spark.range(n).selectExpr(f"cast({y or 'NULL'} AS INT) AS Jaar", "id") for y, n in sizes.items()]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    path = str(tmp_path / "chunks")
    chunks = write_chunks(df, path, limit=100)
    assert dict(rows(chunks, "Jaar", "serie")) == {2003: 1, 2002: 1, 2001: 2, 2000: 2, 1999: 3, None: 4}
    back = spark.read.parquet(path)
    assert {r["Jaar"]: r["count"] for r in back.groupBy("Jaar").count().collect()} == sizes
    assert back.groupBy("Jaar").agg({"serie": "max"}).count() == back.select("Jaar", "serie").distinct().count()
    files = glob.glob(f"{path}/serie=3/*.parquet")
    assert len(files) >= 3 and max(spark.read.parquet(f).count() for f in files) <= 100


def test_shared_dir_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second and first.startswith(root.rstrip("/"))
    settled = settle(spark.range(5), "five")
    empty = settle(spark.range(5).where("id > 9"), "empty")
    assert empty.count() == 0 and empty.columns == ["id"]
    assert settled.count() == 5 and os.path.basename(settled.inputFiles()[0]).endswith(".parquet")


def test_no_folder_without_the_setting():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session(), "x")
