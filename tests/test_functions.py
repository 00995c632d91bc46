import pytest

from tabularium.functions import (
    band,
    codes,
    first_match,
    label_map,
    lacks_code,
    lacks_prefix,
    lacks_text,
    literal,
    member,
    paste,
    percentage,
    period_text,
    recode,
    repair_text,
    round_to,
    strict_if,
    to_int,
)


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate an expression over ``x`` for one value of it."""

    def run(expression, x, kind):
        df = spark.createDataFrame([(x,)], f"x {kind}")
        return df.selectExpr(f"{expression} AS y").first()["y"]

    return run


@pytest.mark.parametrize("text", ["it's", 'say "x"', "back\\slash", "\\x{00}", "Fryslân", "", "a;b\nc"])
def test_literal_keeps_text(spark, text):
    assert spark.sql(f"SELECT {literal(text)} AS t").first()["t"] == text


@pytest.mark.parametrize("x, inside", [(1, True), (3, False), (None, False)])
def test_member_is_never_missing(value, x, inside):
    assert value(member("x", [1, 2]), x, "int") is inside
    assert value(f"NOT {member('x', [1, 2])}", x, "int") is not inside


@pytest.mark.parametrize(
    "name, shown",
    [("WEG", True), (None, True), ("TRANS_X", False), ("TxRANS", True), ("xTRANS_", False)],
)
def test_marker_is_literal_and_missing_name_stays(value, name, shown):
    assert value(lacks_text("x", "TRANS_", "REF_"), name, "string") is shown


@pytest.mark.parametrize("marker", ["a.b", "(x", "a|b", "\\d", "it's", "^a", "[z]", "a+"])
def test_marker_is_no_pattern(value, marker):
    test = lacks_text("x", marker, "other")
    assert value(test, f"..{marker}..", "string") is False
    assert value(test, "aab 5 xz", "string") is True


def test_prefix_and_code_exclusion_keep_missing(value):
    assert value(lacks_prefix("x", "T_"), "T_A", "string") is False
    assert value(lacks_prefix("x", "T_"), "AT_", "string") is True
    assert value(lacks_prefix("x", "T_"), None, "string") is True
    assert value(lacks_code("x", 2), 2, "int") is False
    assert value(lacks_code("x", 2), None, "int") is True


@pytest.mark.parametrize("x, expected", [(5, "hi"), (1, "lo"), (None, None)])
def test_strict_if_is_missing_when_unknown(value, x, expected):
    assert value(strict_if("x > 2", "'hi'", "'lo'"), x, "int") == expected


@pytest.mark.parametrize("x, expected", [("12", 12), (" 7 ", 7), ("3.7", 3), ("x", None), ("", None), (None, None)])
def test_to_int(value, x, expected):
    assert value(to_int("x"), x, "string") == expected


@pytest.mark.parametrize(
    "x, expected",
    [(84.25, 84.2), (84.35, 84.3), (84.75, 84.8), (0.15, 0.1), (2.0, 2.0), (99.96, 100.0), (-1.25, -1.2), (None, None)],
)
def test_round_to_nearest_then_even(value, x, expected):
    assert value(round_to("x"), x, "double") == expected


def test_percentages_are_correctly_rounded(spark):
    pairs = spark.range(1, 301).selectExpr("id AS a").join(spark.range(1, 301).selectExpr("id AS b"))
    got = pairs.selectExpr("a", "b", f"{percentage('a', 'b')} AS p").collect()
    wrong = [(r["a"], r["b"], r["p"]) for r in got if r["p"] != round(r["a"] * 100 / r["b"], 1)]
    assert len(got) == 90_000 and wrong == []


def test_percentage_of_nothing_is_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 3), (5, 0), (NULL, 2), (337, 400) AS t(a, b)")
    got = [r[0] for r in df.selectExpr(f"{percentage('a', 'b')} AS p").collect()]
    assert got == [33.3, None, None, 84.2]


@pytest.mark.parametrize(
    "age, fine, statistical",
    [
        (0, " 0- 5 jaar", "0-14 jaar"),
        (5, " 0- 5 jaar", "0-14 jaar"),
        (6, " 6-11 jaar", "0-14 jaar"),
        (15, "15-17 jaar", "15-19 jaar"),
        (24, "20-24 jaar", "20-24 jaar"),
        (29, "25-29 jaar", "25-29 jaar"),
        (30, "30-34 jaar", "30-39 jaar"),
        (79, "75-79 jaar", "70-79 jaar"),
        (94, "90-94 jaar", "80+"),
        (95, "95+", "80+"),
        (120, "95+", "80+"),
        (121, "121", "121"),
        (32760, "Onbekend", "Onbekend"),
        (None, None, None),
    ],
)
def test_age_bands(value, age, fine, statistical):
    special = {codes.AGE_UNKNOWN: codes.UNKNOWN}
    assert value(band("x", codes.AGE_BANDS, special, "cast(x AS STRING)"), age, "int") == fine
    assert value(band("x", codes.AGE_BANDS_STATISTICAL, special, "cast(x AS STRING)"), age, "int") == statistical


def test_age_bands_have_no_gap_or_overlap():
    for bands in (codes.AGE_BANDS, codes.AGE_BANDS_STATISTICAL, codes.AGE_BANDS_WEEKTIME):
        ages = [age for lo, hi, _ in bands for age in range(lo, hi + 1)]
        assert ages == list(range(121))
    assert len(codes.AGE_BANDS) == 21


def test_first_hit_wins_and_unknown_is_no_hit(value):
    cases = [("x < 5", "small"), ("x < 9", "middle")]
    assert value(first_match(cases, "'rest'"), 3, "int") == "small"
    assert value(first_match(cases, "'rest'"), 7, "int") == "middle"
    assert value(first_match(cases, "'rest'"), None, "int") == "rest"
    assert value(first_match(cases), 20, "int") is None


@pytest.mark.parametrize("code, label", [(0, "Overleden"), (5, "Overleden"), (8, "Naar ziekenhuis"), (10, "Licht letsel"), (11, None), (None, None)])
def test_outcome_codes(value, code, label):
    assert value(recode("x", codes.OUTCOMES), code, "int") == label


def test_every_code_has_one_label():
    for classes in (codes.OUTCOMES, codes.WEEKTIME_MODES, codes.STUDY_MODES, codes.STUDY_OPPONENTS):
        listed = [c for group, _ in classes for c in group]
        assert len(listed) == len(set(listed))


def test_label_map_leaves_other_labels(value):
    assert value(label_map("x", codes.OLD_MODES), "Snorfiets", "string") == "Bromfiets"
    assert value(label_map("x", codes.OLD_MODES), "Fiets", "string") == "Fiets"
    assert value(label_map("x", codes.OLD_MODES), None, "string") is None


@pytest.mark.parametrize(
    "broken, whole",
    [("FryslÃ¢n", "Fryslân"), ("Fryslân", "Fryslân"), ("€ Ã¢", "€ Ã¢"), ("Ã", "Ã"), ("plain", "plain"), (None, None)],
)
def test_repair_text(value, broken, whole):
    assert value(repair_text("x"), broken, "string") == whole


def test_missing_prints_as_text(spark):
    df = spark.sql("SELECT * FROM VALUES (1990, 2000), (NULL, 2000), (NULL, NULL) AS t(a, b)")
    got = df.selectExpr(period_text("a", "b"), paste("a", "b", sep=" tm ")).collect()
    assert [tuple(r) for r in got] == [("1990-2000", "1990 tm 2000"), ("NA-2000", "NA tm 2000"), ("", "NA tm NA")]
