"""The published tables, run on stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import append_filled, group_sum
from ..plans import (
    accident_series,
    casualties_by_road_type,
    casualty_base,
    casualty_tables,
    deaths_by_class,
    deaths_by_road,
    late_accidents,
    late_casualties,
    location_study,
    mode_groups,
    motorcycle_cases,
    municipality_count,
    population_base,
    population_cube,
    population_tables,
    rate_tables,
    rate_wide,
    reconcile_rates,
    road_type_wide,
    variable_lookup,
    weektime_table,
    yearly_rate,
)
from ..sources import settle, tagged
from . import standins
from .base import StandIn, checked, round1_sql, table
from .recodes import FINE_BANDS, STATISTICAL_BANDS, band_sql

# ---------------------------------------------------------------------------------- population

_POPULATION_CTE = f"""
WITH {standins.REGIONS_CTE},
counted AS (
  SELECT jaar, geslacht, lft_inw, gemeente_nr, coalesce(sum(aantal), 0) AS Inwoners
  FROM ({standins.POPULATION.sql}) GROUP BY ALL),
named AS (
  SELECT c.jaar AS Jaar, s.oms AS Geslacht, s.omsgb AS Sex, {band_sql('c.lft_inw', FINE_BANDS)} AS Leeftijd, c.lft_inw,
         c.gemeente_nr, r.Gemeente_naam, r.gemeente_nr_recent, r.Gemeente_naam_recent, r.Provincie, r.Eenheid, r.Politieregio,
         c.Inwoners, c.jaar < 1978 AS vroeg
  FROM counted c
  LEFT JOIN ({standins.codebook_sql(493, 'k')}) s ON s.k = c.geslacht
  LEFT JOIN regions r ON r.gemeente_nr = c.gemeente_nr),
base AS (
  SELECT Jaar,
    CASE WHEN vroeg OR Provincie IS NULL THEN 'Onbekend' ELSE Provincie END AS Provincie,
    CASE WHEN vroeg OR Eenheid IS NULL OR gemeente_nr = 997 THEN 'Onbekend' ELSE Eenheid END AS Eenheid,
    CASE WHEN vroeg OR Politieregio IS NULL THEN 'Onbekend/nvt' ELSE Politieregio END AS Politieregio,
    CASE WHEN vroeg THEN 9999 ELSE gemeente_nr END AS gemeente_nr,
    CASE WHEN vroeg THEN 'Onbekend' ELSE Gemeente_naam END AS Gemeente_naam,
    CASE WHEN vroeg THEN 9999 ELSE gemeente_nr_recent END AS gemeente_nr_recent,
    CASE WHEN vroeg THEN 'Onbekend' ELSE Gemeente_naam_recent END AS Gemeente_naam_recent,
    Geslacht, Sex, Leeftijd, lft_inw, Inwoners
  FROM named)
"""


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    sexes = variable_lookup(standins.codebook(spark), "sex")
    return population_base(standins.POPULATION.read(spark, sf_dir), sexes, standins.regions(spark, sf_dir))


@checked(
    "population_cube",
    f"""
    {_POPULATION_CTE}
    SELECT 'Gemeenten_historisch' AS tabel, Jaar, Provincie, Eenheid, Politieregio, gemeente_nr, Gemeente_naam,
           gemeente_nr_recent, Gemeente_naam_recent, NULL::VARCHAR AS Geslacht, NULL::VARCHAR AS Sex, NULL::VARCHAR AS Leeftijd,
           CAST(sum(Inwoners) AS BIGINT) AS Inwoners
    FROM base GROUP BY ALL
    UNION ALL
    SELECT 'Gemeenten_recent_lft_sex', Jaar, Provincie, Eenheid, Politieregio, NULL, NULL,
           gemeente_nr_recent, Gemeente_naam_recent, Geslacht, Sex, Leeftijd, CAST(sum(Inwoners) AS BIGINT)
    FROM base GROUP BY ALL
    UNION ALL
    SELECT 'Inwoners_regio_leeftijd', Jaar, Provincie, Eenheid, Politieregio, NULL, NULL, NULL, NULL,
           Geslacht, Sex, CAST(lft_inw AS VARCHAR), CAST(sum(Inwoners) AS BIGINT)
    FROM base GROUP BY ALL
    """,
)
def population_cube_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = population_cube(_population(spark, sf_dir))
    age = "CASE WHEN tabel = 'Inwoners_regio_leeftijd' THEN cast(lft_inw AS STRING) ELSE Leeftijd END AS Leeftijd"
    return cube.selectExpr(*[age if c == "Leeftijd" else f"`{c}`" for c in cube.columns if c != "lft_inw"])


_PROVINCES = ["Groningen", "Fryslân", "Drenthe", "Overijssel", "Onbekend"]
_PROVINCE_CELLS = ", ".join(
    f"count(*) FILTER (WHERE Provincie = '{p}' AND gemeente_nr IS NOT NULL) AS \"{p}\"" for p in _PROVINCES
)


@checked(
    "municipality_count",
    f"""
    {_POPULATION_CTE},
    d AS (SELECT DISTINCT Jaar, Provincie, gemeente_nr FROM base WHERE Jaar >= 1978),
    w AS (SELECT Jaar, {_PROVINCE_CELLS} FROM d GROUP BY Jaar)
    SELECT *, {" + ".join(f'"{p}"' for p in _PROVINCES)} AS sum FROM w
    """,
)
def municipality_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    historic = population_tables(_population(spark, sf_dir))["Gemeenten_historisch"]
    return municipality_count(historic, _PROVINCES, codes.FIRST_YEAR_WITH_REGIONS)


# ---------------------------------------------------------------------------------- registration rate

# one pre-counted source at the finest level; the seven breakdowns are sums of it
_RATES = StandIn(
    "lineitem",
    {
        "JAAR": "cast(year(l_shipdate) as int)",
        "LETSELERNST_IVO2": "cast(case when l_tax < 0.055 then 1 else 2 end as int)",
        "WEEKDAG": "l_linenumber",
        "LEEFTIJD_IVO2": "cast(round(l_discount * 100) as int)",
        "MAAND": "cast(month(l_shipdate) as int)",
        "PROV_IVO": "cast((l_linenumber + month(l_shipdate)) % 5 as int)",
        "SEXE": "cast(case l_linestatus when 'F' then 1 else 2 end as int)",
        "UUR_IVO2": "cast((l_linenumber * 3 + month(l_shipdate)) % 24 as int)",
        "VVM_IVO": "cast(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end + l_linenumber % 3 as int)",
        "SLA_VOR": "case when l_returnflag = 'N' or l_discount > 0.095 then 0 else l_quantity end",
        "SLA_IVO": "case when l_discount > 0.095 then 0 else l_quantity end",
    },
)
_MEASURES = ["SLA_VOR", "SLA_IVO"]
_KEYS = {key: (sheet, variable) for sheet, (key, variable, _, _) in codes.RATE_TABLES.items()}
# the test tables run from 1995 to 2001, so the shorter periods of weekday and hour are moved to fit
_YEARS = {"Dag": (1996, 1999), "Tijdstip": (1998, 2000)}


def _rate_tables(spark: SparkSession, sf_dir: str, published: bool) -> dict[str, DataFrame]:
    rows = _RATES.read(spark, sf_dir)
    keys = [c for c in rows.columns if c not in _MEASURES]
    sums = [F.expr(f"sum({m}) AS {m}") for m in _MEASURES]
    # seven stored tables in real life; here seven sums of one table, which is therefore read once
    base = settle(rows.groupBy(*keys).agg(*sums), "rates")
    sources = {key: base.groupBy("JAAR", "LETSELERNST_IVO2", key).agg(*sums) for key in _KEYS}
    years = _YEARS if published else dict.fromkeys(_YEARS, (1996, None))
    return rate_tables(sources, standins.codebook(spark), years, ordered=False)


# for the SQL, apart from the code under test: key, sheet, codebook variable, first and last year, English label
_RATE_SHEETS = {
    "MAAND": ("Maand", 419, 1996, 9999, "b.omsgb"),
    "WEEKDAG": ("Dag", 200, 1996, 1999, "b.omsgb"),
    "UUR_IVO2": ("Tijdstip", 930, 1998, 2000, "b.omsgb"),
    "PROV_IVO": ("Provincie", 556, 1996, 9999, "NULL"),
    "VVM_IVO": ("Vervoerswijze", 551, 1996, 9999, "b.omsgb"),
    "LEEFTIJD_IVO2": ("Leeftijd", 929, 1996, 9999, "b.omsgb"),
    "SEXE": ("Geslacht", 264, 1996, 9999, "b.omsgb"),
}


def _rate_sql(key: str) -> str:
    sheet, number, first, last, english = _RATE_SHEETS[key]
    return f"""
    SELECT '{sheet}' AS tabel, Jaar, label, label_en, Werkelijk, Geregistreerd, {round1_sql('pct')} AS Registratiegraad
    FROM (
      SELECT c.JAAR AS Jaar,
             CASE b.oms WHEN 'FryslÃ¢n' THEN 'Fryslân' WHEN 'Overyssel' THEN 'Overijssel'
               WHEN 'Overyssel + Flevoland' THEN 'Overijssel + Flevoland' ELSE b.oms END AS label, {english} AS label_en,
             c.ivo AS Werkelijk, c.vor AS Geregistreerd, c.vor * 100 / nullif(c.ivo, 0) AS pct
      FROM (SELECT JAAR, {key} AS k, CAST(sum(SLA_VOR) AS DOUBLE) AS vor, CAST(sum(SLA_IVO) AS DOUBLE) AS ivo
            FROM src WHERE LETSELERNST_IVO2 = 1 AND JAAR BETWEEN {first} AND {last} GROUP BY ALL) c
      LEFT JOIN codebook b ON b.var_nr = {number} AND try_cast(b.code AS INTEGER) = c.k)
    """


_RATE_CTE = f"WITH codebook AS ({standins.CODEBOOK_SQL}), src AS ({_RATES.sql})"


@checked("registration_rate", _RATE_CTE + " UNION ALL ".join(_rate_sql(k) for k in _RATE_SHEETS))
def registration_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for sheet, df in _rate_tables(spark, sf_dir, published=True).items():
        _, variable, _, _ = codes.RATE_TABLES[sheet]
        _, _, label, label_en, _, _ = codes.VARIABLES[variable]
        parts.append(
            df.selectExpr(
                f"'{sheet}' AS tabel",
                "Jaar",
                f"{label} AS label",
                f"{label_en or 'cast(NULL AS STRING)'} AS label_en",
                "Werkelijk",
                "Geregistreerd",
                "Registratiegraad",
            )
        )
    return append_filled(*parts)


_WIDE_YEARS = list(range(1996, 2002))


@checked(
    "registration_rate_wide",
    f"""
    {_RATE_CTE}, r AS ({_rate_sql('SEXE')})
    SELECT label AS Geslacht, label_en AS Sex,
           {", ".join(f"max(Registratiegraad) FILTER (WHERE Jaar = {y}) AS j{y}" for y in _WIDE_YEARS)}
    FROM r GROUP BY ALL
    """,
)
def registration_rate_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_wide(
        _rate_tables(spark, sf_dir, published=True)["Geslacht"], "Registratiegraad", _WIDE_YEARS, prefix="j"
    )


def _reconcile_sql(measure: str, name: str) -> str:
    sheets = [sheet for sheet, *_ in _RATE_SHEETS.values()]
    dims = " UNION ALL ".join(
        f"SELECT '{sheet}' AS dim, JAAR AS Jaar, sum({measure}) AS n FROM src"
        f" WHERE LETSELERNST_IVO2 = 1 AND JAAR >= 1996{' AND JAAR < 2000' if sheet == 'Dag' else ''} GROUP BY ALL"
        for sheet in sheets
    )
    cells = ", ".join(f"CAST(max(n) FILTER (WHERE dim = '{s}') AS DOUBLE) AS {s}" for s in sheets)
    equal = " AND ".join(f"Geslacht = {s}" for s in sheets)
    return (
        f"SELECT '{name}' AS maat, *, CAST(coalesce({equal}, false) AS INTEGER) AS all_equal"
        f" FROM (SELECT Jaar, {cells} FROM ({dims}) GROUP BY Jaar)"
    )


@checked(
    "rate_reconciliation",
    f"WITH src AS ({_RATES.sql}) {_reconcile_sql('SLA_IVO', 'Werkelijk')} UNION ALL {_reconcile_sql('SLA_VOR', 'Geregistreerd')}",
)
def rate_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _rate_tables(spark, sf_dir, published=False)
    tables["Dag"] = tables["Dag"].where("Jaar < 2000")
    return reconcile_rates(tables).withColumn("all_equal", F.col("all_equal").cast("int"))


@checked(
    "yearly_totals",
    """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS Jaar, CAST(sum(l_quantity) AS BIGINT) AS Werkelijk,
           CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS BIGINT) AS Geregistreerd,
           sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) / nullif(sum(l_quantity), 0) AS Registratiegraad
    FROM lineitem GROUP BY ALL
    """,
)
def yearly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "year(l_shipdate) AS Jaar",
        "cast(l_quantity AS BIGINT) AS echt",
        "if(l_returnflag = 'N', 0, cast(l_quantity AS BIGINT)) AS gemeld",
    )
    return yearly_rate(lines, "gemeld", "echt")


# ---------------------------------------------------------------------------------- two sources


@checked(
    "two_period_series",
    f"""
    WITH {standins.REGIONS_CTE},
    auth AS (SELECT code, oms FROM codebook WHERE var_nr = 203),
    nieuw AS (
      SELECT jaar AS Jaar, CASE WHEN ernong5 = 1 THEN 'Dodelijk' WHEN ernong5 = 5 THEN 'UMS' ELSE 'Letsel' END AS Ernst_ongeval,
             CASE WHEN PVrapp IN (1, 2, 6, 7) THEN 'PV/Regset/KMM+' WHEN ernong5 <> 5 THEN 'PV/Regset/KMM+'
                  WHEN PVrapp = 9 THEN 'KMM' WHEN PVrapp IN (10, 11) THEN 'IM' END AS pv,
             key_gem AS gemeente_nr, a.oms AS Wegbeheerder
      FROM ({standins.NEW_ACCIDENTS.sql}) n LEFT JOIN auth a ON a.code = CAST(n.wegbeh AS VARCHAR) WHERE jaar >= 1987),
    oud_rijen AS (
      SELECT Jaar, Ndood, gemeente_nr, wegbeh FROM ({standins.OLD_ACCIDENTS.sql}) WHERE Jaar < 1987
      UNION ALL
      SELECT CASE WHEN JAAR = 92 THEN 1992 ELSE 1993 END, NDOOD, KEY_GEM, WEGBEH FROM ({standins.LATE_ACCIDENTS.sql})),
    oud AS (
      SELECT Jaar, CASE WHEN Ndood = 0 THEN 'Letsel' ELSE 'Dodelijk' END AS Ernst_ongeval, 'PV/Regset/KMM+' AS pv, gemeente_nr,
             CASE WHEN a.oms IN ('Spoorwegen', 'Staatsbosbeheer') THEN 'Overige instanties' ELSE a.oms END AS Wegbeheerder
      FROM oud_rijen o LEFT JOIN auth a ON a.code = CAST(o.wegbeh AS VARCHAR)),
    alles AS (SELECT * FROM nieuw UNION ALL SELECT * FROM oud)
    SELECT Jaar, Ernst_ongeval, pv, r.gemeente_nr_recent, r.Gemeente_naam_recent, r.Gemeente_naam, r.Provincie,
           r.Politieregio, r.Eenheid, Wegbeheerder, count(*) AS Aantal
    FROM alles a LEFT JOIN regions r ON r.gemeente_nr = a.gemeente_nr GROUP BY ALL
    """,
)
def two_period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accident_series(
        standins.NEW_ACCIDENTS.read(spark, sf_dir),
        standins.OLD_ACCIDENTS.read(spark, sf_dir),
        late_accidents(standins.LATE_ACCIDENTS.read(spark, sf_dir)),
        standins.regions(spark, sf_dir),
        variable_lookup(standins.codebook(spark), "authority"),
    )


_CASUALTY_CTE = f"""
WITH {standins.REGIONS_CTE},
nieuw AS (
  SELECT n.jaar AS Jaar, n.ernstsl, n.key_gem AS gemeente_nr, n.lftsl, n.sexesl, b.oms AS Vervoerswijze
  FROM ({standins.NEW_CASUALTIES.sql}) n LEFT JOIN ({standins.NEW_MODES_SQL}) m ON m.OTE_ID = n.ote_sl
  LEFT JOIN codebook b ON b.var_nr = 551 AND b.code = CAST(m.VVM_IVO AS VARCHAR) WHERE n.jaar >= 1987),
oud_rijen AS (
  SELECT Jaar, ernstsl, gemeente_nr, VVM, lftsl, sexesl FROM ({standins.OLD_CASUALTIES.sql}) WHERE Jaar < 1987
  UNION ALL
  SELECT 1992, s.ERNSTSL, s.KEY_GEM, o.VVM, s.LFTSL, s.SEXESL
  FROM ({standins.LATE_CASUALTIES.sql}) s LEFT JOIN ({standins.LATE_OBJECTS.sql}) o
    ON o.VORNUM = s.VORNUM AND o.KEY_OBJ IS NOT DISTINCT FROM s.KEY_OBJ),
oud AS (
  SELECT o.Jaar, o.ernstsl, o.gemeente_nr, o.lftsl, o.sexesl,
         CASE WHEN b.oms = 'Snorfiets' THEN 'Bromfiets' WHEN b.oms IN ('Overig vvm', 'Losse voorwerpen', 'Bomen', 'Overige obstakel') THEN 'Overig'
              WHEN b.oms = 'Motor/scooter' THEN 'Motor' WHEN b.oms = 'Lopen' THEN 'Voetganger'
              WHEN b.oms IN ('Auto', 'Bestelauto') THEN 'Auto/bestel' WHEN b.oms IN ('Vrachtauto', 'Bus') THEN 'Vrachtauto/bus'
              ELSE b.oms END AS Vervoerswijze
  FROM oud_rijen o LEFT JOIN ({standins.OLD_MODES_SQL}) m ON m.VVM = o.VVM
  LEFT JOIN codebook b ON b.var_nr = 916 AND b.code = CAST(m.VVMSH AS VARCHAR)),
alles AS (SELECT * FROM nieuw UNION ALL BY NAME SELECT * FROM oud),
named AS (
  SELECT a.Jaar, CASE WHEN ernstsl BETWEEN 0 AND 5 THEN 'Overleden' WHEN ernstsl BETWEEN 6 AND 8 THEN 'Naar ziekenhuis'
                      WHEN ernstsl BETWEEN 9 AND 10 THEN 'Licht letsel' END AS Afloop,
         r.Provincie, r.Gemeente_naam_recent, r.Gemeente_naam, Vervoerswijze, s.oms AS Geslacht,
         {band_sql('lftsl', STATISTICAL_BANDS)} AS Leeftijd
  FROM alles a LEFT JOIN regions r ON r.gemeente_nr = a.gemeente_nr
  LEFT JOIN codebook s ON s.var_nr = 493 AND s.code = CASE WHEN sexesl IN (1, 2) THEN CAST(sexesl AS VARCHAR) ELSE '3' END)
"""


@checked(
    "casualty_series",
    f"""
    {_CASUALTY_CTE}
    SELECT 'Gemeente' AS tabel, Jaar, CASE WHEN Afloop IN ('Naar ziekenhuis', 'Licht letsel') THEN 'Letsel' ELSE Afloop END AS Afloop,
           Provincie, Gemeente_naam_recent, Gemeente_naam, NULL AS Vervoerswijze, NULL AS Leeftijd, NULL AS Geslacht, count(*) AS Aantal
    FROM named GROUP BY ALL
    UNION ALL
    SELECT 'Vervoerswijze', Jaar, Afloop, Provincie, NULL, NULL, Vervoerswijze, Leeftijd, Geslacht, count(*) FROM named GROUP BY ALL
    """,
)
def casualty_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = standins.codebook(spark)
    base = casualty_base(
        standins.NEW_CASUALTIES.read(spark, sf_dir),
        standins.OLD_CASUALTIES.read(spark, sf_dir),
        late_casualties(
            standins.LATE_CASUALTIES.read(spark, sf_dir), standins.LATE_OBJECTS.read(spark, sf_dir), 1992
        ),
        standins.regions(spark, sf_dir),
        spark.sql(standins.NEW_MODES_SQL),
        spark.sql(standins.OLD_MODES_SQL),
        variable_lookup(book, "mode"),
        variable_lookup(book, "old_mode"),
        variable_lookup(book, "sex_text"),
    )
    return append_filled(*[tagged(df, tabel=name) for name, df in casualty_tables(base).items()])


# ---------------------------------------------------------------------------------- single tables

_DEATHS = StandIn(
    "lineitem",
    {
        "JAAR": "cast(year(l_shipdate) as int)",
        "LEEFTIJD_4_75": "l_linenumber",
        "VERVOER2": "cast(l_partkey % 6 as int)",
        "DOOD": "cast(case when l_partkey % 6 = 1 or l_linenumber = 4 then 0 else l_quantity end as bigint)",
    },
)


@checked(
    "deaths_by_class",
    f"""
    WITH codebook AS ({standins.CODEBOOK_SQL}),
    d AS (SELECT JAAR, LEEFTIJD_4_75, VERVOER2, CAST(coalesce(sum(DOOD), 0) AS BIGINT) AS DOOD FROM ({_DEATHS.sql}) GROUP BY ALL),
    a AS (SELECT try_cast(code AS INTEGER) AS k, replace(oms, '-', ' t/m ') AS oms FROM codebook WHERE var_naam = 'leeftijd_4_75'),
    v AS (SELECT try_cast(code AS INTEGER) AS k, oms, omsgb FROM codebook WHERE var_naam = 'vervoer2')
    SELECT d.JAAR AS Jaar, CASE a.oms WHEN '0  t/m  4' THEN ' 0 t/m  4' WHEN '5  t/m  9' THEN ' 5 t/m  9' ELSE a.oms END AS Leeftijdsklasse,
           v.oms AS Vervoerswijze, v.omsgb AS TransportMode, d.DOOD AS Verkeersdoden
    FROM d LEFT JOIN a ON a.k = d.LEEFTIJD_4_75 LEFT JOIN v ON v.k = d.VERVOER2 WHERE d.DOOD > 0
    """,
)
def deaths_by_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = standins.codebook(spark)
    counted = group_sum(
        _DEATHS.read(spark, sf_dir), "JAAR", "LEEFTIJD_4_75", "VERVOER2", measure="DOOD"
    )
    return deaths_by_class(
        counted,
        variable_lookup(book, "death_age"),
        variable_lookup(book, "death_mode"),
    )


@checked(
    "week_time_class",
    f"""
    WITH e AS ({standins.WEEKTIME.sql}),
    c AS (
      SELECT *, CASE WHEN ote_sl = 71 THEN 'Voetganger' WHEN ote_sl IN (64, 66, 67) THEN 'Fietser' WHEN ote_sl IN (31, 61, 62) THEN 'GTW'
                     WHEN ote_sl IN (1, 11, 21, 22, 23) THEN 'Motorvoertuig' WHEN ote_sl IN (93, 94, 32760, 32761) THEN 'Onbekend'
                     ELSE 'Anders' END AS vvm FROM e),
    k AS (
      SELECT CASE WHEN ernstsl BETWEEN 0 AND 5 THEN 'Dood' WHEN ernstsl BETWEEN 6 AND 8 THEN 'NaarZH' WHEN ernstsl BETWEEN 9 AND 10 THEN 'Licht' END AS ernst,
        vvm,
        CASE WHEN lftsl BETWEEN 0 AND 15 THEN ' 0-15' WHEN lftsl BETWEEN 16 AND 17 THEN '16-17' WHEN lftsl BETWEEN 18 AND 24 THEN '18-24'
             WHEN lftsl BETWEEN 25 AND 34 THEN '25-34' WHEN lftsl BETWEEN 35 AND 49 THEN '35-49' WHEN lftsl BETWEEN 50 AND 120 THEN '50+'
             ELSE 'onbekend' END AS kleeft,
        CASE WHEN sexesl = 1 THEN 'Man' WHEN sexesl = 2 THEN 'Vrouw' ELSE 'Onbekend' END AS geslacht,
        CASE WHEN weekdag = 1 AND uur BETWEEN 6 AND 17 THEN 'weekend dag' WHEN weekdag = 7 AND uur BETWEEN 6 AND 17 THEN 'weekend dag'
             WHEN uur BETWEEN 6 AND 17 THEN 'week dag' WHEN weekdag = 1 AND uur BETWEEN 0 AND 5 THEN 'weekendnacht'
             WHEN weekdag = 6 AND uur BETWEEN 18 AND 24 THEN 'weekendnacht' WHEN weekdag = 7 AND uur BETWEEN 0 AND 5 THEN 'weekendnacht'
             WHEN weekdag = 7 AND uur BETWEEN 18 AND 24 THEN 'weekendnacht' ELSE 'week nacht' END AS tijd,
        CASE WHEN vvm IN ('GTW', 'Motorvoertuig', 'Onbekend', 'Anders') THEN 'nvt' WHEN botspartner = 71 THEN 'voetganger'
             WHEN botspartner IN (64, 66) THEN 'fietser' WHEN botspartner IN (1, 11, 21, 22, 23) THEN 'motorvoertuig'
             WHEN botspartner = 32761 THEN 'geen' ELSE 'anders' END AS tegenp
      FROM c)
    SELECT *, count(*) AS n FROM k GROUP BY ALL
    """,
)
def week_time_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weektime_table(standins.WEEKTIME.read(spark, sf_dir))


_TOWNS = [f"Gemeente {i}" for i in (0, 1, 2, 4, 7, 11, 16, 19)]
_EXTRA = ["8", "23"]


@checked(
    "case_selection",
    f"""
    WITH s AS ({standins.STUDY_CASUALTIES.sql}),
    o AS (
      SELECT * FROM ({standins.STUDY_ACCIDENTS.sql})
      WHERE ernong5 < 5 AND pve_naam = 'Zuid-Holland' AND gme_naam IN ({", ".join(f"'{t}'" for t in _TOWNS)})
        AND (N_motor > 0 OR vervoersw_detail_A IN (31, 32, 33) OR vervoersw_detail_B IN (31, 32, 33) OR vornum IN ('8', '23'))),
    j AS (
      SELECT s.*, o.ernong5, o.datum, o.N_motor, o.gme_naam
      FROM s LEFT JOIN o ON o.jaar = s.jaar AND o.vornum = s.vornum AND o.wegbeh IS NOT DISTINCT FROM s.wegbeh AND o.loctypon = s.loctypon
        AND o.bebouw = s.bebouw AND o.maxsne IS NOT DISTINCT FROM s.maxsne AND o.key_gem = s.key_gem
      WHERE (o.ernong5 IS NOT NULL OR s.ote_sl IN (31, 32, 33) OR s.botspartner IN (31, 32, 33)
             OR s.vervoersw_detail IN (31, 32, 33) OR s.tegenpartij_detail IN (31, 32, 33))
        AND s.key_gem IN (SELECT key_gem FROM o)),
    r AS (
      SELECT jaar, vornum, wegbeh, bebouw, maxsne, sexesl, lftsl, datum, gme_naam, func,
        CASE WHEN N_motor = 0 THEN 1 WHEN N_motor <> 0 THEN N_motor END AS N_motor,
        CASE WHEN ernstsl BETWEEN 0 AND 5 THEN 'dood' WHEN ernstsl BETWEEN 6 AND 8 THEN 'naar ZH' WHEN ernstsl IN (9, 10) THEN 'licht' END AS ernst,
        CASE loctypon WHEN 20 THEN 'Kruispunt' WHEN 21 THEN 'Wegvak' END AS locatietype,
        CASE WHEN vervoersw_detail = 31 THEN 'Motor' WHEN vervoersw_detail = 32 THEN 'Motor 3wielen' WHEN ote_sl = 31 THEN 'Motor'
             WHEN ote_sl IN (1, 11) THEN 'Auto/bestel' WHEN ote_sl IN (61, 62) THEN 'Brom/snor' WHEN ote_sl IN (64, 66) THEN 'Fiets/Ebike'
             WHEN ote_sl = 65 THEN 'Scootm' WHEN ote_sl = 71 THEN 'Voetg' WHEN ote_sl = 93 THEN 'GeenPartij' WHEN ote_sl = 94 THEN 'Anders' END AS vvm,
        CASE WHEN tegenpartij_detail = 31 THEN 'Motor' WHEN tegenpartij_detail = 32 THEN 'Motor 3wielen' WHEN botspartner = 31 THEN 'Motor'
             WHEN botspartner IN (1, 11) THEN 'Auto/bestel' WHEN botspartner IN (21, 22, 24, 41) THEN 'VraBusLandb'
             WHEN botspartner IN (61, 62) THEN 'Brom/snor' WHEN botspartner IN (64, 66) THEN 'Fiets/Ebike' WHEN botspartner = 65 THEN 'Scootm'
             WHEN botspartner = 71 THEN 'Voetg' WHEN botspartner IN (81, 83, 84, 85, 91) THEN 'Object/dier'
             WHEN botspartner IN (93, 94) THEN 'GeenPartij' WHEN botspartner = 32761 THEN 'Geen' END AS tegenp
      FROM j)
    SELECT * EXCLUDE (func), CASE WHEN vvm IN ('Motor', 'Motor 3wielen') AND func = 1 THEN 'bestuurder'
             WHEN vvm IN ('Motor', 'Motor 3wielen') AND func = 2 THEN 'passagier' ELSE 'nvt' END AS wvd
    FROM r
    """,
)
def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motorcycle_cases(
        standins.STUDY_CASUALTIES.read(spark, sf_dir),
        standins.STUDY_ACCIDENTS.read(spark, sf_dir),
        "Zuid-Holland",
        _TOWNS,
        _EXTRA,
    )


@checked(
    "mode_groups",
    f"""
    SELECT hoofdgroep, cob_code AS code, cob_label AS oms FROM ({standins.MODES.sql})
    ORDER BY hoofdgroep_code NULLS LAST, cob_code
    """,
)
def mode_groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_groups(standins.MODES.read(spark, sf_dir))


# ---------------------------------------------------------------------------------- road types

_ROAD_YEARS = list(range(1995, 2002))


def _wide_sql(select: str, value: str) -> str:
    cells = ", ".join(
        f"CAST(CASE WHEN count(*) FILTER (WHERE jaar = {y}) = 0 THEN NULL"
        f" ELSE coalesce({value} FILTER (WHERE jaar = {y}), 0) END AS BIGINT) AS j{y}"
        for y in _ROAD_YEARS
    )
    return f"SELECT {select}, {cells}"


@checked(
    "road_type_by_year",
    f"""
    WITH c AS ({standins.ROAD_CATEGORIES.sql}), s AS ({standins.ROAD_CASUALTIES.sql}),
    t AS (SELECT s.jaar, c.wegtype FROM s LEFT JOIN c ON c.jaar = s.jaar AND c.vornum = s.vornum WHERE s.ernstsl IN (0, 1, 2, 3, 4, 5)),
    k AS (SELECT * FROM c WHERE jaar BETWEEN 1995 AND 2001 AND ernong5 = 1)
    {_wide_sql("'doden' AS tabel, wegtype", "sum(n_slacht_dood)")} FROM k GROUP BY wegtype
    UNION ALL {_wide_sql("'ongevallen' AS tabel, wegtype", "count(*)")} FROM k GROUP BY wegtype
    UNION ALL {_wide_sql("'slachtoffers' AS tabel, wegtype", "count(*)")} FROM t GROUP BY wegtype
    """,
)
def road_type_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = standins.ROAD_CATEGORIES.read(spark, sf_dir)
    tables = road_type_wide(categories, _ROAD_YEARS)
    tables = {
        name: df.withColumnsRenamed({str(y): f"j{y}" for y in _ROAD_YEARS}) for name, df in tables.items()
    }
    tables["slachtoffers"] = casualties_by_road_type(
        standins.ROAD_CASUALTIES.read(spark, sf_dir), categories, _ROAD_YEARS, prefix="j"
    )
    return append_filled(*[tagged(df, tabel=name) for name, df in tables.items()])


@checked(
    "location_study",
    f"""
    WITH s AS (SELECT vornum, loctypon, count(*) AS ndood FROM ({standins.ROAD_CASUALTIES.sql}) WHERE jaar = 1998 AND maxsne = 50 AND ernstsl IN (0, 1, 2, 3, 4, 5) GROUP BY ALL)
    SELECT loctypon, count(*) AS ongevallen, CAST(sum(ndood) AS BIGINT) AS doden FROM s GROUP BY ALL
    """,
)
def location_study_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return location_study(standins.ROAD_CASUALTIES.read(spark, sf_dir), 1998, 50)


_SPEEDS, _AUTHORITIES = [30, 50, 80, None], [1, 2, 3, 4]


def _road_deaths_sql(by: str, across: str, values: list, where: str) -> str:
    cells = ", ".join(
        f"CAST(nullif(count(*) FILTER (WHERE {across} IS NOT DISTINCT FROM {'NULL' if v is None else v}), 0) AS BIGINT) AS n{'null' if v is None else v}"
        for v in values
    )
    return f"""
    WITH c AS ({standins.ROAD_CATEGORIES.sql}), s AS ({standins.ROAD_CASUALTIES.sql})
    SELECT {by}, {cells} FROM s LEFT JOIN c ON c.jaar = s.jaar AND c.vornum = s.vornum
    WHERE s.jaar = 1998 AND s.ernstsl IN (0, 1, 2, 3, 4, 5) AND {where} GROUP BY {by}
    """


@checked("deaths_by_speed", _road_deaths_sql("wegtype, wegbeh", "maxsne", _SPEEDS, "bebouw <> 2"))
def deaths_by_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths outside of rural roads by road type and authority, speed limits side by side."""
    casualties = standins.ROAD_CASUALTIES.read(spark, sf_dir)
    categories = standins.ROAD_CATEGORIES.read(spark, sf_dir)
    return deaths_by_road(casualties, categories, 1998, ["wegtype", "wegbeh"], "maxsne", _SPEEDS, "bebouw <> 2", prefix="n")


@checked("deaths_by_authority", _road_deaths_sql("loctypon", "wegbeh", _AUTHORITIES, "wegtype = '2-HIGH'"))
def deaths_by_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths on one road type by kind of place, road authorities side by side."""
    casualties = standins.ROAD_CASUALTIES.read(spark, sf_dir)
    categories = standins.ROAD_CATEGORIES.read(spark, sf_dir)
    return deaths_by_road(casualties, categories, 1998, ["loctypon"], "wegbeh", _AUTHORITIES, "wegtype = '2-HIGH'", prefix="n")
