import random

import pytest
from conftest import rows

from tabularium.operators import (
    append,
    append_filled,
    arrange,
    attach,
    codebook_lookup,
    codebook_slice,
    contingency,
    flag_present,
    full_merge,
    group_count,
    group_sum,
    keep_keys,
    last_per_group,
    left_lookup,
    missing_from,
    pack_years,
    reconcile,
    require_unique,
    reshape_wide,
    rollups,
    running_total,
    same_total,
    successors,
    two_periods,
    weighted_count,
    wide_count,
    with_summary,
)

BOOK = "var_nr int, var_naam string, code string, oms string, omsgb string"


@pytest.fixture(scope="module")
def book(frame):
    return frame(
        BOOK,
        (25, "provincie", "1", "FryslÃ¢n", "F"),
        (25, "", "2", "Drenthe", "D"),
        (25, None, "x", "Kapot", "K"),
        (99, "provincie", "3", "Zeeland", "Z"),
        (203, "wegbeh", "1", "Rijk", "State"),
    )


def test_slice_finds_name_or_number(book):
    assert rows(codebook_slice(book, 25, "provincie"), "code") == [("1",), ("2",), ("3",), ("x",)]
    assert rows(codebook_slice(book, number=203), "oms") == [("Rijk",)]
    with pytest.raises(ValueError):
        codebook_slice(book)


def test_lookup_types_key_and_repairs_label(book):
    lookup = codebook_lookup(
        book, 25, "provincie", label="Provincie", label_en="Province", repairs={"FryslÃ¢n": "Fryslân"}
    )
    assert rows(lookup) == [(1, "Fryslân", "F"), (2, "Drenthe", "D"), (3, "Zeeland", "Z")]
    assert rows(codebook_lookup(book, 203, label="w", numeric=False)) == [("1", "Rijk")]


def test_left_lookup_keeps_every_row(frame):
    fact = frame("k int, v int", (1, 10), (2, 20), (7, 70), (None, 5))
    ref = frame("code int, label string", (1, "a"), (2, "b"), (3, "c"))
    assert rows(left_lookup(fact, ref, {"k": "code"})) == [
        (None, 5, None),
        (1, 10, "a"),
        (2, 20, "b"),
        (7, 70, None),
    ]


def test_null_key_matches_only_when_asked(frame):
    fact = frame("k int", (1,), (None,))
    ref = frame("k int, label string", (1, "a"), (None, "none"))
    assert rows(left_lookup(fact, ref, "k")) == [(None, None), (1, "a")]
    assert rows(left_lookup(fact, ref, "k", null_safe=True)) == [(None, "none"), (1, "a")]


def test_doubled_lookup_key_is_refused(frame):
    fact = frame("k int", (2,))
    ref = frame("k int, label string", (1, "a"), (1, "b"), (2, "c"))
    with pytest.raises(Exception, match="lookup key occurs twice"):
        left_lookup(fact, ref, "k").collect()
    with pytest.raises(Exception, match="lookup key occurs twice"):
        require_unique(ref, "k").collect()
    assert len(require_unique(ref.where("label <> 'b'"), "k").collect()) == 2


def test_successors_take_the_regions_of_the_present_area(frame):
    areas = frame(
        "nr int, naam string, nr_recent int, prov int",
        (1, "Oud", 3, 9),
        (2, "Ouder", 3, 8),
        (3, "Nieuw", 3, 7),
        (4, "Los", 99, 6),
    )
    assert rows(successors(areas, "nr", "nr_recent").select("nr", "naam", "nr_recent", "naam_recent", "prov")) == [
        (1, "Oud", 3, "Nieuw", 7),
        (2, "Ouder", 3, "Nieuw", 7),
        (3, "Nieuw", 3, "Nieuw", 7),
        (4, "Los", 99, None, None),
    ]


def test_attach_matches_missing_keys_by_choice(frame):
    left = frame("a int, b int, v string", (1, None, "x"), (1, 2, "y"), (None, 2, "z"))
    right = frame("a int, b int, w string", (1, None, "p"), (1, 2, "q"), (None, 2, "r"))
    assert rows(attach(left, right, ["a", "b"]), "v", "w") == [("x", "p"), ("y", "q"), ("z", "r")]
    assert rows(attach(left, right, ["a", "b"], null_safe=["b"]), "v", "w") == [("x", "p"), ("y", "q"), ("z", None)]
    assert rows(attach(left, right, ["a", "b"], null_safe=False), "v", "w") == [("x", None), ("y", "q"), ("z", None)]
    with pytest.raises(ValueError, match="both sides"):
        attach(left, right.withColumnRenamed("w", "V"), ["a", "b"])


def _full_outer(a, b):
    out = [(k, v, w) for k, v in a for q, w in b if q == k]
    out += [(k, v, None) for k, v in a if k not in {q for q, _ in b}]
    out += [(q, None, w) for q, w in b if q not in {k for k, _ in a}]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_full_merge_is_a_full_outer_join(frame, seed):
    rng = random.Random(seed)
    keys = [None, 1, 2, 3, 4, 5]
    # one key holds a third of the many side
    a = [(3 if rng.random() < 0.33 else rng.choice(keys), i) for i in range(60)]
    b = [(k, 100 + i) for i, k in enumerate(rng.sample([None, 3, 4, 5, 8, 9], 4))]
    got = rows(full_merge(frame("k int, v int", *a), frame("k int, w int", *b), "k"))
    assert got == sorted(_full_outer(a, b), key=lambda r: [(v is not None, str(v)) for v in r])


def test_membership(frame):
    a = frame("k int", (1,), (2,), (2,), (None,))
    b = frame("q int", (2,), (2,), (None,))
    assert rows(keep_keys(a, b, {"k": "q"})) == [(None,), (2,), (2,)]
    assert rows(missing_from(a, b, {"k": "q"})) == [(1,)]
    assert rows(flag_present(a, b, {"k": "q"})) == [(None, True), (1, False), (2, True), (2, True)]


def test_summary_next_to_details(frame):
    detail = frame("k int, v int", (1, 1), (1, 2), (None, 3))
    summary = group_count(detail, "k")
    expected = [(None, 3, 1), (1, 1, 2), (1, 2, 2)]
    assert rows(with_summary(detail, summary, "k")) == expected
    assert rows(with_summary(detail, summary, "k", bounded=True)) == expected


def test_sums_skip_missing_and_empty_sum_is_zero(frame):
    df = frame("g string, m int", ("a", 1), ("a", None), ("b", None), (None, 4))
    assert rows(group_sum(df, "g", measure="m")) == [(None, 4), ("a", 1), ("b", 0)]
    assert rows(weighted_count(df, "g", weight="m", name="s")) == [(None, 4), ("a", 1), ("b", 0)]
    assert rows(weighted_count(df, "g")) == [(None, 1), ("a", 2), ("b", 1)]


def test_contingency_fills_zero_and_treats_missing(frame):
    df = frame("a string, b int", ("x", 1), ("x", 1), ("y", 2), (None, 1), ("x", None))
    assert rows(contingency(df, "a", "b", [1, 2])) == [("x", 2, 0), ("y", 0, 1)]
    assert rows(contingency(df, "a", "b")) == [("x", 2, 0), ("y", 0, 1)]
    assert contingency(df, "a", "b", missing_level=True).columns == ["a", "1", "2", "NA"]
    with_na = contingency(df, "a", "b", [1, 2], missing_level=True)
    assert with_na.columns == ["a", "1", "2", "NA"]
    assert rows(with_na) == [("NA", 1, 0, 0), ("x", 2, 0, 1), ("y", 0, 1, 0)]


def test_wide_count_keeps_absent_cells_missing(frame):
    df = frame("g string, y int, m int", ("a", 2001, 5), ("a", 2001, None), ("b", 2000, None))
    wide = wide_count(df, "g", period="y", periods=[2001, 2000], weight="m", prefix="j")
    assert wide.columns == ["g", "j2001", "j2000"]
    assert rows(wide) == [("a", 5, None), ("b", None, 0)]
    assert wide_count(df, "g", period="y").columns == ["g", "2000", "2001"]


def test_reshape_and_back_is_the_identity(frame):
    long = frame("g string, y int, v double", ("a", 1, 1.5), ("a", 2, 2.5), ("b", 1, 3.5), (None, 2, 4.5))
    wide = reshape_wide(long, "y", "v", [1, 2], prefix="y")
    back = wide.unpivot(["g"], ["y1", "y2"], "name", "v").where("v IS NOT NULL")
    assert rows(back.selectExpr("g", "int(substr(name, 2)) AS y", "v")) == rows(long)
    with pytest.raises(Exception, match="two values"):
        reshape_wide(long.unionByName(long), "y", "v", [1, 2]).collect()


def test_rollups_keep_the_total(frame):
    base = frame("a int, b string, n int", (1, "x", 3), (1, "y", 4), (2, "x", 5))
    out = rollups(base, {"a": ["a"], "b": ["b"]}, "n")
    assert rows(out["a"]) == [(1, 7), (2, 5)]
    assert rows(out["b"]) == [("x", 8), ("y", 4)]
    total = same_total(out["a"], "n", *[base.limit(0), frame("z int", *[(i,) for i in range(12)])])
    assert rows(total) == [(12, 12, True)]


def test_reconcile_reports_differences(frame):
    a = frame("j int, n int", (2000, 3), (2000, 4), (2001, 5))
    b = frame("j int, n int", (2000, 7), (2001, 6), (2002, 1))
    assert rows(reconcile({"a": a, "b": b}, "j", "n")) == [
        (2000, 7, 7, True),
        (2001, 5, 6, False),
        (2002, None, 1, False),
    ]


def test_last_row_takes_missing_date_and_breaks_ties(frame):
    df = frame(
        "g int, d date, nr int, v string",
        *[
            (g, d, nr, v)
            for g, d, nr, v in [
                (1, None, 1, "open"),
                (2, None, 1, None),
                (2, None, 0, "older"),
            ]
        ],
    ).unionByName(
        frame("g int, d string, nr int, v string", (1, "2020-01-01", 2, "b"), (3, "2020-01-01", 1, "a"), (3, "2020-01-01", 2, None))
        .selectExpr("g", "cast(d AS DATE) AS d", "nr", "v")
    )
    assert rows(last_per_group(df, ["g"], ["d", "nr"], ["v"])) == [(1, "open"), (2, None), (3, None)]


def test_arrange_puts_missing_last_and_drops_keys(frame):
    df = frame("a int, b int", (1, 2), (None, 1), (2, None), (2, 1))
    assert [tuple(r) for r in arrange(df, "a", "b").collect()] == [(1, 2), (2, 1), (2, None), (None, 1)]
    assert [tuple(r) for r in arrange(df, "-a", "b", drop=["a"]).collect()] == [(1,), (None,), (2,), (1,)]


def test_append_checks_columns(frame):
    a = frame("x int, y string", (1, "a"))
    b = frame("y string, x int", ("b", 2))
    assert rows(append(a, b)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="columns differ"):
        append(a, b.drop("y"))
    assert rows(append_filled(a, b.drop("y"))) == [(1, "a"), (2, None)]


def test_two_periods_count_no_year_twice(frame):
    old = frame("j int, s string", *[(y, "old") for y in (1985, 1986, 1987, 1988)])
    new = frame("j int", *[(y,) for y in (1985, 1986, 1987, 1988)])
    late = frame("j int, s string", (1992, "late"))
    got = rows(two_periods(old, new, "j", 1987, late))
    assert got == [(1985, "old"), (1986, "old"), (1987, None), (1988, None), (1992, "late")]


def _packed(counts, limit):
    out, size, chunk, cum = [], 0, 1, 0
    for year, n in sorted(counts, reverse=True):
        if size > 0 and size + n > limit:
            chunk, size = chunk + 1, 0
        size, cum = size + n, cum + n
        out.append((year, n, cum, chunk))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pack_years(frame, seed):
    rng = random.Random(seed)
    counts = [(y, rng.randint(1, 60)) for y in rng.sample(range(1950, 2025), 30)]
    limit = rng.randint(20, 200)
    df = frame("Jaar int, n bigint", *counts)
    packed = pack_years(df, limit=limit)
    assert rows(packed) == _packed(counts, limit)
    assert rows(running_total(df), "Jaar", "cum") == rows(packed, "Jaar", "cum")


def test_a_value_without_a_column_fails(frame):
    df = frame("k string, j int, n bigint", ("a", 2000, 1), ("b", 2001, 2))
    assert rows(wide_count(df, "k", period="j", periods=[2000, 2001], weight="n")) == [("a", 1, None), ("b", None, 2)]
    for wide in (
        wide_count(df, "k", period="j", periods=[2000]),
        reshape_wide(df, "j", "n", [2000]),
        contingency(df, "k", "j", [2000]),
        wide_count(frame("k string, j int", ("a", None)), "k", period="j", periods=[2000]),
    ):
        with pytest.raises(Exception, match="without a column"):
            wide.collect()


def test_pack_years_refuses_what_are_no_years(spark):
    counts = spark.range(20_000).selectExpr("id AS Jaar", "1L AS n")
    for made in (pack_years(counts), running_total(counts)):
        with pytest.raises(Exception, match="not a calendar year"):
            made.collect()
        with pytest.raises(Exception, match="not a calendar year"):
            made.count()


def test_running_total_keeps_every_year(spark):
    counts = spark.range(10_000).selectExpr("id AS Jaar", "1L AS n").unionByName(spark.sql("SELECT cast(NULL AS BIGINT) AS Jaar, 5L AS n"))
    total = running_total(counts)
    assert total.count() == total.select("Jaar").count() == 10_001
    assert total.agg({"cum": "max"}).first()[0] == 10_005
    assert pack_years(counts, limit=100).count() == 10_001
