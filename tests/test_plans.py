"""The published tables on hand-made rows."""

import pytest
from conftest import rows

from tabularium.functions import codes
from tabularium.plans import (
    accident_series,
    casualties_by_road_type,
    casualty_base,
    casualty_tables,
    data_overview,
    deaths_by_class,
    delivery_summary,
    late_accidents,
    late_casualties,
    listed_tables,
    location_study,
    mode_groups,
    motorcycle_cases,
    municipality_count,
    population_base,
    population_tables,
    profile_catalog,
    profile_tables,
    rate_table,
    rate_tables,
    rate_wide,
    reconcile_rates,
    region_dimension,
    road_type_wide,
    system_tables,
    table_registry,
    weektime_class,
    weektime_table,
    yearly_rate,
)
from tabularium.plans.motorcycle import OUTPUT
from tabularium.sources import table_list


@pytest.fixture(scope="module")
def regions(frame):
    areas = frame(
        "gemeente_nr int, Gemeente_naam string, gemeente_nr_recent int, provincie int, politie_regio int, eenheid int",
        (1, "Oud", 2, 8, 8, 8),
        (2, "Nieuw", 2, 1, 1, 1),
        (997, "Zee", 997, 1, None, 1),
        (5, "Elders", 5, 9, 9, 9),
    )
    labels = "code int, {} string"
    return region_dimension(
        areas,
        frame(labels.format("Provincie"), (1, "Drenthe"), (8, "Fout")),
        frame(labels.format("Politieregio"), (1, "Noord"), (8, "Fout")),
        frame(labels.format("Eenheid"), (1, "Eenheid N"), (8, "Fout")),
    )


def test_region_of_the_past_is_the_region_of_today(regions):
    assert rows(regions) == [
        (1, 2, "Nieuw", "Oud", "Drenthe", "Noord", "Eenheid N"),
        (2, 2, "Nieuw", "Nieuw", "Drenthe", "Noord", "Eenheid N"),
        (5, 5, "Elders", "Elders", None, None, None),
        (997, 997, "Zee", "Zee", "Drenthe", None, "Eenheid N"),
    ]


@pytest.fixture(scope="module")
def population(frame, regions):
    people = frame(
        "jaar int, geslacht int, lft_inw int, gemeente_nr int, aantal bigint",
        (1977, 1, 30, 1, 10),
        (1978, 1, 30, 1, 20),
        (1978, 1, 30, 1, None),
        (1978, 2, 32760, 997, 5),
        (1978, 2, 31, 5, 7),
        (1978, 3, 99, 77, 2),
        (1978, 1, 30, 2, 1),
    )
    sexes = frame("code int, Geslacht string, Sex string", (1, "Man", "Male"), (2, "Vrouw", "Female"))
    return population_base(people, sexes, regions)


def test_population_base_masks_unknown_regions(population):
    got = rows(population, "Jaar", "Provincie", "Eenheid", "Politieregio", "gemeente_nr", "gemeente_nr_recent", "Leeftijd", "Inwoners")
    unknown = "Onbekend"
    assert got == [
        (1977, unknown, unknown, "Onbekend/nvt", 9999, 9999, "30-34 jaar", 10),
        (1978, "Drenthe", "Eenheid N", "Noord", 1, 2, "30-34 jaar", 20),
        (1978, "Drenthe", "Eenheid N", "Noord", 2, 2, "30-34 jaar", 1),
        (1978, "Drenthe", unknown, "Onbekend/nvt", 997, 997, unknown, 5),
        (1978, unknown, unknown, "Onbekend/nvt", 5, 5, "30-34 jaar", 7),
        (1978, unknown, unknown, "Onbekend/nvt", 77, None, "95+", 2),
    ]


def test_population_tables_hold_the_same_total(population):
    tables = population_tables(population)
    assert set(tables) == {"Gemeenten_historisch", "Gemeenten_recent_lft_sex", "Inwoners_regio_leeftijd"}
    for df in tables.values():
        assert df.agg({"Inwoners": "sum"}).first()[0] == 45
    recent = rows(tables["Gemeenten_recent_lft_sex"], "Jaar", "gemeente_nr_recent", "Geslacht", "Inwoners")
    assert (1978, 2, "Man", 21) in recent
    ordered = population_tables(population, ordered=True)["Inwoners_regio_leeftijd"].collect()
    assert [r["Jaar"] for r in ordered] == sorted(r["Jaar"] for r in ordered)
    assert [r["Leeftijd"] for r in ordered if r["Geslacht"] == "Vrouw"] == [32760, 31]


def test_municipality_count(population):
    historic = population_tables(population)["Gemeenten_historisch"]
    assert rows(municipality_count(historic, ["Drenthe", "Onbekend"], 1978)) == [(1978, 3, 2, 5)]


RATE = "JAAR int, LETSELERNST_IVO2 int, MAAND int, SLA_VOR double, SLA_IVO double"


def test_rate_table_rounds_filters_and_sorts(frame):
    source = frame(
        RATE,
        (1997, 1, 2, 337.0, 400.0),
        (1997, 1, 1, 1.0, 0.0),
        (1996, 1, 1, 2.0, 3.0),
        (1996, 2, 1, 9.0, 9.0),
        (1995, 1, 1, 9.0, 9.0),
        (1997, 1, 7, 5.0, 5.0),
    )
    lookup = frame("code int, Maand string, Month string", (1, "januari", "January"), (2, "februari", "February"))
    out = rate_table(source, "MAAND", lookup)
    assert out.columns == ["Jaar", "Maand", "Month", "Werkelijk", "Geregistreerd", "Registratiegraad"]
    assert [tuple(r) for r in out.collect()] == [
        (1996, "januari", "January", 3.0, 2.0, 66.7),
        (1997, "januari", "January", 0.0, 1.0, None),
        (1997, "februari", "February", 400.0, 337.0, 84.2),
        (1997, None, None, 5.0, 5.0, 100.0),
    ]
    assert rows(rate_table(source, "MAAND", lookup, last_year=1996), "Jaar") == [(1996,)]
    wide = rate_wide(out, "Werkelijk", [1996, 1997])
    assert rows(wide, "Maand", "1996", "1997") == [
        (None, None, 5.0),
        ("februari", None, 400.0),
        ("januari", 3.0, 0.0),
    ]


def test_rates_reconcile(frame):
    a = frame("Jaar int, Werkelijk double, Geregistreerd double", (2000, 2.0, 1.0), (2000, 3.0, 1.0))
    b = frame("Jaar int, Werkelijk double, Geregistreerd double", (2000, 5.0, 3.0))
    out = reconcile_rates({"maand": a, "sexe": b})
    assert rows(out) == [("Geregistreerd", 2000, 2.0, 3.0, False), ("Werkelijk", 2000, 5.0, 5.0, True)]


def test_yearly_rate_is_a_fraction(frame):
    df = frame("Jaar int, v int, i int", (1996, 1180, 1251), (1997, 0, 0))
    assert rows(yearly_rate(df, "v", "i")) == [(1996, 1251, 1180, 1180 / 1251), (1997, 0, 0, None)]


def test_accident_series_joins_two_sources(frame, regions):
    new = frame(
        "jaar int, ernong5 int, PVrapp int, key_gem int, wegbeh int",
        (1986, 1, 1, 1, 1),
        (1987, 1, 1, 1, 1),
        (1987, 5, 9, 1, 3),
        (1987, 4, 9, 1, 3),
        (1987, None, 10, 77, None),
        (1987, 5, 12, 2, 1),
    )
    old = frame(
        "Jaar int, Ndood int, gemeente_nr int, wegbeh int",
        (1986, 0, 1, 3),
        (1986, 2, 2, 3),
        (1986, None, 2, 1),
        (1987, 1, 1, 1),
    )
    late = late_accidents(
        frame("JAAR int, KEY_GEM int, WEGBEH int, NDOOD int", (92, 1, 1, 1)),
        frame("JAAR int, KEY_GEM int, WEGBEH int, NDOOD int", (93, 1, 1, 0)),
    )
    authorities = frame("code string, Wegbeheerder string", ("1", "Rijk"), ("3", "Spoorwegen"))
    out = accident_series(new, old, late, regions, authorities)
    got = rows(out, "Jaar", "Ernst_ongeval", "pv", "Gemeente_naam", "Provincie", "Wegbeheerder", "Aantal")
    full = "PV/Regset/KMM+"
    assert got == [
        (1986, "Dodelijk", full, "Nieuw", "Drenthe", "Overige instanties", 1),
        (1986, "Dodelijk", full, "Nieuw", "Drenthe", "Rijk", 1),
        (1986, "Letsel", full, "Oud", "Drenthe", "Overige instanties", 1),
        (1987, "Dodelijk", full, "Oud", "Drenthe", "Rijk", 1),
        (1987, "Letsel", "IM", None, None, None, 1),
        (1987, "Letsel", full, "Oud", "Drenthe", "Spoorwegen", 1),
        (1987, "UMS", None, "Nieuw", "Drenthe", "Rijk", 1),
        (1987, "UMS", "KMM", "Oud", "Drenthe", "Spoorwegen", 1),
        (1992, "Dodelijk", full, "Oud", "Drenthe", "Rijk", 1),
        (1993, "Letsel", full, "Oud", "Drenthe", "Rijk", 1),
    ]


def test_casualty_series_counts_every_row_once(frame, regions):
    new = frame(
        "jaar int, ernstsl int, key_gem int, ote_sl int, sexesl int, lftsl int",
        (1986, 1, 1, 1, 1, 30),
        (1987, 3, 1, 1, 1, 30),
        (1987, 7, 1, 1, 9, 14),
        (1987, 10, 1, 5, None, 32760),
        (1987, 11, 2, None, 2, None),
    )
    old = frame(
        "Jaar int, ernstsl int, gemeente_nr int, VVM int, lftsl int, sexesl int",
        (1986, 0, 1, 1, 80, 2),
        (1987, 0, 1, 1, 80, 2),
    )
    late = late_casualties(
        frame("VORNUM int, KEY_OBJ int, ERNSTSL int, KEY_GEM int, LFTSL int, SEXESL int", (1, 1, 9, 2, 20, 1), (2, None, 9, 2, 20, 1)),
        frame("VORNUM int, KEY_OBJ int, VVM int", (1, 1, 2), (2, None, 1)),
        1992,
    )
    base = casualty_base(
        new,
        old,
        late,
        regions,
        frame("OTE_ID int, VVM_IVO int", (1, 1), (5, 4)),
        frame("VVM int, VVMSH int", (1, 0), (2, 5)),
        frame("code string, Vervoerswijze string", ("1", "Auto/bestel"), ("4", "Overig")),
        frame("code string, Vervoerswijze string", ("0", "Auto"), ("5", "Snorfiets")),
        frame("code string, Geslacht string", ("1", "Man"), ("2", "Vrouw"), ("3", "Onbekend")),
    )
    out = casualty_tables(base)
    assert rows(out["Vervoerswijze"]) == [
        (1986, "Overleden", "Drenthe", "Auto/bestel", "80+", "Vrouw", 1),
        (1987, None, "Drenthe", None, None, "Vrouw", 1),
        (1987, "Licht letsel", "Drenthe", "Overig", "Onbekend", "Onbekend", 1),
        (1987, "Naar ziekenhuis", "Drenthe", "Auto/bestel", "0-14 jaar", "Onbekend", 1),
        (1987, "Overleden", "Drenthe", "Auto/bestel", "30-39 jaar", "Man", 1),
        (1992, "Licht letsel", "Drenthe", "Auto/bestel", "20-24 jaar", "Man", 1),
        (1992, "Licht letsel", "Drenthe", "Bromfiets", "20-24 jaar", "Man", 1),
    ]
    assert (1987, "Letsel", "Drenthe", "Nieuw", "Oud", 2) in rows(out["Gemeente"])
    assert out["Gemeente"].agg({"Aantal": "sum"}).first()[0] == 7


def test_deaths_by_class(frame):
    deaths = frame(
        "JAAR int, LEEFTIJD_4_75 int, VERVOER2 int, DOOD int",
        (1951, 2, 1, 4),
        (1950, 3, 2, 3),
        (1950, 1, 1, 2),
        (1950, 2, 1, 0),
        (1950, 1, 9, 1),
    )
    ages = frame("code int, Leeftijdsklasse string", (1, "0 - 4"), (2, "5 - 9"), (3, "10-14"))
    modes = frame("code int, Vervoerswijze string, TransportMode string", (1, "Auto", "Car"), (2, "Fiets", "Bicycle"))
    assert [tuple(r) for r in deaths_by_class(deaths, ages, modes).collect()] == [
        (1950, " 0 t/m  4", "Auto", "Car", 2),
        (1950, " 0 t/m  4", None, None, 1),
        (1950, "10 t/m 14", "Fiets", "Bicycle", 3),
        (1951, " 5 t/m  9", "Auto", "Car", 4),
    ]


@pytest.mark.parametrize(
    "weekday, hour, label",
    [
        (1, 6, "weekend dag"),
        (7, 17, "weekend dag"),
        (2, 12, "week dag"),
        (None, 12, "week dag"),
        (1, 5, "weekendnacht"),
        (1, 20, "week nacht"),
        (6, 5, "week nacht"),
        (6, 18, "weekendnacht"),
        (7, 0, "weekendnacht"),
        (7, 24, "weekendnacht"),
        (3, 2, "week nacht"),
        (1, None, "week nacht"),
        (None, None, "week nacht"),
    ],
)
def test_weektime_class(frame, weekday, hour, label):
    df = frame("d int, u int", (weekday, hour))
    assert df.selectExpr(weektime_class("d", "u")).first()[0] == label


def test_weektime_table_tells_opponents_of_the_vulnerable_only(frame):
    df = frame(
        "ernstsl int, ote_sl int, lftsl int, sexesl int, weekdag int, uur int, botspartner int",
        (1, 71, 15, 1, 2, 12, 11),
        (7, 64, 16, 2, 2, 12, 32761),
        (9, 66, 121, 3, 2, 12, 99),
        (11, 1, None, None, 2, 12, 71),
        (1, None, 50, 1, 2, 12, 71),
    )
    assert rows(weektime_table(df)) == [
        (None, "Motorvoertuig", "onbekend", "Onbekend", "week dag", "nvt", 1),
        ("Dood", "Anders", "50+", "Man", "week dag", "nvt", 1),
        ("Dood", "Voetganger", " 0-15", "Man", "week dag", "motorvoertuig", 1),
        ("Licht", "Fietser", "onbekend", "Onbekend", "week dag", "anders", 1),
        ("NaarZH", "Fietser", "16-17", "Vrouw", "week dag", "geen", 1),
    ]


CASUALTY = (
    "jaar int, vornum string, wegbeh int, loctypon int, bebouw int, maxsne int, key_gem int, ernstsl int, ote_sl int,"
    " botspartner int, vervoersw_detail int, tegenpartij_detail int, sexesl int, lftsl int, func int"
)
ACCIDENT = (
    "jaar int, vornum string, wegbeh int, loctypon int, bebouw int, maxsne int, key_gem int, ernong5 int, datum string,"
    " N_motor int, vervoersw_detail_A int, vervoersw_detail_B int, gme_naam string, pve_naam string"
)


def test_motorcycle_cases(frame):
    accidents = frame(
        ACCIDENT,
        (2022, "a", None, 20, 1, None, 10, 2, "2022-01-01", 0, 31, None, "Delft", "Zuid-Holland"),
        (2022, "b", 1, 21, 1, 50, 10, 2, "2022-01-02", 2, 1, 1, "Delft", "Zuid-Holland"),
        (2022, "c", 1, 21, 1, 50, 10, 5, "2022-01-03", 2, 1, 1, "Delft", "Zuid-Holland"),
        (2022, "d", 1, 21, 1, 50, 11, 2, "2022-01-04", None, 1, 1, "Gouda", "Zuid-Holland"),
        (2022, "e", 1, 21, 1, 50, 12, 2, "2022-01-05", 2, 1, 1, "Breda", "Noord-Brabant"),
    )
    casualties = frame(
        CASUALTY,
        (2022, "a", None, 20, 1, None, 10, 3, 64, 31, 99, 32, 1, 30, 1),
        (2022, "b", 1, 21, 1, 50, 10, 7, 31, 93, 99, 99, 2, 40, 1),
        (2022, "b", 1, 21, 1, 60, 10, 9, 1, 32761, 99, 99, 2, 41, 2),
        (2022, "c", 1, 21, 1, 50, 10, 9, 1, 31, 32, 99, 2, 42, 2),
        (2022, "d", 1, 21, 1, 50, 11, 9, 71, 11, 99, 99, 1, 43, 1),
        (2022, "e", 1, 21, 1, 50, 12, 9, 31, 11, 99, 99, 1, 44, 1),
    )
    out = motorcycle_cases(casualties, accidents, "Zuid-Holland", ["Delft", "Gouda"], ["d"])
    assert out.columns == OUTPUT
    assert rows(out, "vornum", "lftsl", "N_motor", "ernst", "locatietype", "vvm", "tegenp", "wvd", "gme_naam") == [
        ("a", 30, 1, "dood", "Kruispunt", "Fiets/Ebike", "Motor 3wielen", "nvt", "Delft"),
        ("b", 40, 2, "naar ZH", "Wegvak", "Motor", "GeenPartij", "bestuurder", "Delft"),
        ("c", 42, None, "licht", "Wegvak", "Motor 3wielen", "Motor", "passagier", None),
        ("d", 43, None, "licht", "Wegvak", "Voetg", "Auto/bestel", "nvt", "Gouda"),
    ]


def test_road_types(frame):
    categories = frame(
        "jaar int, vornum bigint, wegtype string, n_slacht_dood int, ernong5 int",
        (2020, 1, "A", 2, 1),
        (2021, 2, "A", None, 1),
        (2021, 3, None, 1, 1),
        (2019, 4, "A", 5, 1),
        (2020, 5, "A", 7, 2),
        (2020, 6, "B", 7, None),
    )
    wide = road_type_wide(categories, [2020, 2021])
    assert rows(wide["doden"]) == [(None, None, 1), ("A", 2, 0)]
    assert rows(wide["ongevallen"]) == [(None, None, 1), ("A", 1, 1)]
    casualties = frame(
        "jaar int, vornum bigint, maxsne int, loctypon int, ernstsl int",
        *[(2020, 1, 50, 20, i) for i in range(5)],
        (2020, 2, 50, 20, 5),
        (2021, 2, 50, 21, 3),
        (2021, None, 50, 21, 0),
        (2020, 9, 80, 20, 1),
        # no deaths
        (2020, 1, 50, 20, 6),
        (2020, 3, 50, 20, 9),
        (2020, 4, 50, 22, None),
        (2021, 2, 50, 21, 10),
    )
    assert rows(casualties_by_road_type(casualties, categories, [2020, 2021], prefix="j")) == [
        (None, 2, 1),
        ("A", 5, 1),
    ]
    assert rows(location_study(casualties, 2020, 50)) == [(20, 2, 6)]


def test_profile_finds_period_and_leaves_out_what_cannot_be_read(frame):
    day = "cast('{}' AS DATE)"
    tables = {
        ("dbo", "plain"): frame("a int, b int", (1, 2), (3, 4)),
        ("dbo", "jaren"): frame("ROWID int, Jaar int, b int", (1, 1999, 2), (2, 2003, None), (3, None, 1)),
        ("dbo", "leeg"): frame("jaar int"),
        ("Admin1", "weer"): frame("jaar int", (-2000,), (2010,)),
        ("Admin1", "BAG_ANDERS"): frame("jaar int", (-2000,), (2010,)),
        ("Admin1", "sartre_gordel"): frame("jaar int", (1, )),
        ("Admin1", "looptijd"): frame("x int", (1,), (2,)).selectExpr(
            f"{day.format('1990-05-05')} AS BEGDAT", f"if(x = 1, NULL, {day.format('2020-01-01')}) AS EndDat"
        ),
        ("Admin1", "wegvak"): frame("x int", (1,)).selectExpr(
            f"{day.format('1991-05-05')} AS wvk_begdat", "cast(NULL AS DATE) AS wvk_einddat"
        ),
        ("dbo", "test"): frame("jaar int", (1,)),
    }
    got = {r["dmx_naam"]: tuple(r)[2:] for r in profile_tables(tables).collect()}
    assert got == {
        "PLAIN": (2, 2, None, None),
        "JAREN": (3, 2, 1999, 2003),
        "LEEG": (0, 1, None, None),
        "WEER": (2, 1, 1985, 2010),
        "BAG_ANDERS": (2, 1, -2000, 2010),
        "SARTRE_GORDEL": (1, 1, 1992, 2003),
        "LOOPTIJD": (2, 2, 1990, 2020),
        "WEGVAK": (1, 2, 1991, 1991),
        "TEST": (None, None, None, None),
    }


def test_profile_of_a_catalogue_feeds_the_registry(spark, frame):
    spark.sql("CREATE DATABASE IF NOT EXISTS register")
    spark.sql("CREATE TABLE register.ongeval USING parquet AS SELECT cast(id AS INT) + 2000 AS jaar, id FROM range(5)")
    spark.sql("CREATE TABLE register.weg (a INT, rowid INT) USING parquet")
    spark.sql("CREATE TABLE register.politie (jaar INT) USING parquet")
    profile = profile_catalog(spark, ["register"], batch=2)
    assert rows(profile) == [
        ("register", "ONGEVAL", 5, 2, 2000, 2004, None),
        ("register", "POLITIE", None, None, None, None, None),
        ("register", "WEG", 0, 1, None, None, None),
    ]
    profile = profile.drop("error")
    listed = listed_tables(table_list(spark, ["register"]))
    matrices = frame("dmx_nr int, dmx_naam string, dmx_type int", (1, "Weg", 3), (2, "elders", 3))
    # the list holds names as stored; the registry merges on the stored name
    registry = table_registry(listed.selectExpr("Udmx_naam AS dmx_naam", "Udmx_naam", "schema_naam"), profile, matrices)
    assert rows(registry, "dmx_naam", "dmx_nr", "rijen") == [
        ("ELDERS", 2, None),
        ("ONGEVAL", None, 5),
        ("POLITIE", None, None),
        ("WEG", 1, 0),
    ]


def test_mode_groups_come_in_order(frame):
    modes = frame("cob_code int, cob_label string, hoofdgroep string, hoofdgroep_code int", (5, "e", "B", 2), (7, None, "A", 1), (3, "c", "B", 2), (1, "a", None, None))
    assert [tuple(r) for r in mode_groups(modes).collect()] == [("A", 7, None), ("B", 3, "c"), ("B", 5, "e"), (None, 1, "a")]


def test_a_broken_table_costs_its_own_row(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS gebroken")
    spark.sql("CREATE TABLE gebroken.goed USING parquet AS SELECT 1999 AS jaar")
    spark.sql(f"CREATE TABLE gebroken.stuk (jaar INT) USING parquet LOCATION '{tmp_path}/stuk'")
    (tmp_path / "stuk").mkdir(exist_ok=True)
    (tmp_path / "stuk" / "part-0.parquet").write_bytes(b"no parquet at all")
    spark.range(3).createOrReplaceTempView("tijdelijk")
    got = profile_catalog(spark, ["gebroken"]).collect()
    assert [tuple(r)[1:6] for r in sorted(got, key=lambda r: r.dmx_naam)] == [("GOED", 1, 1, 1999, 1999), ("STUK", None, None, None, None)]
    assert [bool(r.error) for r in sorted(got, key=lambda r: r.dmx_naam)] == [False, True]
    assert profile_catalog(spark, []).count() == 0


def test_source_years_reach_the_scan(spark, regions, frame, capsys, tmp_path):
    spark.sql("SELECT 1990 AS jaar, 1 AS ernong5, 1 AS PVrapp, 1 AS key_gem, 1 AS wegbeh, 'x' AS extra").write.parquet(f"{tmp_path}/n")
    spark.sql("SELECT 1980 AS Jaar, 1 AS Ndood, 1 AS gemeente_nr, 1 AS wegbeh, 'x' AS extra").write.parquet(f"{tmp_path}/o")
    authorities = frame("code string, Wegbeheerder string", ("1", "Rijk"))
    out = accident_series(spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/o"), None, regions, authorities)
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(jaar,1987)" in plan and "LessThan(Jaar,1987)" in plan and "extra" not in plan
    assert out.agg({"Aantal": "sum"}).first()[0] == 2


DELIVERY = (
    "prod_nr int, lever_datum string, lever_omschrijving string, lever_archief string, lever_periode int,"
    " lever_voorwaarde string, lever_bewaartermijn int, lever_IB_klasse int, lever_IB_opvolging int, nr int"
)


def test_delivery_summary(frame):
    deliveries = frame(
        DELIVERY,
        (1, "2020-01-01", "first", "a", 2019, "v", 1, None, 2, 1),
        (1, None, "open", None, None, "w", 2, None, None, 2),
        (2, "2021-05-05", "x", "a", None, "v", 1, 3, None, 7),
        (2, "2021-05-05", None, "b", None, "u", 5, 1, None, 8),
        (None, "2021-05-05", "lost", "b", 1, "u", 5, 1, 1, 9),
    )
    out = delivery_summary(deliveries, tie_break=["nr"])
    assert rows(out) == [
        (1, "2020-01-01", "2020-01-01", "open", None, "w", 2, None, 2, 2, "2019 tm 2019"),
        (2, "2021-05-05", "2021-05-05", None, "b", "u", 5, 3, None, 2, None),
    ]


def test_data_overview(frame):
    catalog = frame(
        "schema_id int, name string, modify_date string, type_desc string",
        (1, "WEG", "2024-01-01 10:00:00", "t"),
        (5, "WEG_OLD", "2024-01-01 10:00:00", "t"),
        (1, "kleine", "2024-01-01 10:00:00", "t"),
        (5, "klein5", "2024-01-01 10:00:00", "t"),
        (6, "TMP", "2024-01-01 10:00:00", "t"),
    )
    profile = frame(
        "schema string, dmx_naam string, rijen bigint, kolommen int, minY int, maxY int",
        ("dbo", "WEG", 10, 3, 1990, 2000),
        ("Admin1", "KLEIN5", 5, 2, None, 2001),
    )
    matrices = frame(
        "dmx_nr int, dmx_naam string, dmx_type int, dmx_omschrijving string, dmx_pasop_nl string",
        (1, "weg", 3, "wegen", "pas op"),
        (2, "ander", 2, "transformatie", None),
        (3, "los", None, "los", None),
    )
    registry = table_registry(system_tables(catalog), profile, matrices)
    names = rows(registry, "dmx_naam", "Udmx_naam", "schema_naam", "dmx_nr")
    assert names == [
        ("ANDER", "ANDER", None, 2),
        ("LOS", "LOS", None, 3),
        ("WEG", "WEG", "dbo", 1),
        ("WEG_OLD", "WEG_OLD", "Admin1", None),
        ("klein5", "KLEIN5", "Admin1", None),
        ("kleine", "KLEINE", "dbo", None),
    ]
    products = frame(
        "prod_nr int, org_nr int, prod_naam string, prod_update int, prod_docu string, prod_memo string, prod_beheerder string",
        (10, 1, "Wegen", 365, "d", "m", "b"),
        (11, 9, "Leeg", 371, None, None, None),
        (12, 2, "Transform", None, None, None, None),
    )
    summary = delivery_summary(frame(DELIVERY, (10, "2020-01-01", "first", "a", 2019, "v", 1, 4, 2, 1)))
    sources = frame("prod_nr int, dmx_nr int", (10, 1), (12, 2), (10, 77))
    organisations = frame("org_nr int, org_naam_kort string", (1, "WHO"), (2, "RWS"), (3, "Stil"))
    out = data_overview(organisations, products, summary, sources, registry)
    got = [(r["Product"], r["Bronhouder"], r["Frequentie"], r["lever_aantal"], r["Tabel"], r["Periode"]) for r in out.collect()]
    assert got == [
        (None, "Stil", None, 0, None, ""),
        ("Leeg", None, "na meerdere jaren", 0, None, ""),
        (None, None, None, 0, "LOS", ""),
        (None, None, None, 0, "klein5", "NA-2001"),
        ("Wegen", "WHO", "jaarlijks", 1, "WEG", "1990-2000"),
        ("Wegen", "WHO", "jaarlijks", 1, None, ""),
    ]


def test_codebook_lookup_feeds_a_plan(frame):
    book = frame(
        "var_nr int, var_naam string, code string, oms string, omsgb string",
        (419, "maand", "1", "januari", "January"),
        (419, "maand", "??", "fout", "wrong"),
        (556, None, "1", "Overyssel", ""),
    )
    counted = frame(
        "JAAR int, LETSELERNST_IVO2 int, k int, SLA_VOR double, SLA_IVO double",
        *[(year, 1, 1, 1.0, 2.0) for year in (1995, 1996, 2000, 2001, 2021, 2022)],
    )
    sources = {key: counted.withColumnRenamed("k", key) for key, _, _, _ in codes.RATE_TABLES.values()}
    out = rate_tables(sources, book)
    assert rows(out["Maand"])[0] == (1996, "januari", "January", 2.0, 1.0, 50.0)
    assert rows(out["Provincie"], "Jaar", "Provincie")[0] == (1996, "Overijssel")
    years = {sheet: [r[0] for r in rows(df, "Jaar")] for sheet, df in out.items()}
    assert years["Dag"] == [1996, 2000, 2001, 2021] and years["Tijdstip"] == [2001, 2021]
    assert years["Leeftijd"] == [1996, 2000, 2001, 2021, 2022]
