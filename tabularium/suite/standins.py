"""Test tables in the shape of the source tables, with missing values and unknown codes put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import codes
from ..plans import region_dimension, variable_lookup
from ..sources import settle
from .base import StandIn

# municipality number: 24 turns into the one without unit, 25 is not in the list, 26 is missing
def _municipality(key: str) -> str:
    return (
        f"cast(case {key} % 27 when 24 then {codes.MUNICIPALITY_WITHOUT_UNIT}"
        f" when 26 then null else {key} % 27 end as int)"
    )


def _age(key: str) -> str:
    return f"cast(case {key} % 131 when 130 then {codes.AGE_UNKNOWN} when 129 then null else {key} % 131 end as int)"


MUNICIPALITIES = StandIn(
    "nation",
    {
        "gemeente_nr": f"cast(case n_nationkey when 24 then {codes.MUNICIPALITY_WITHOUT_UNIT} else n_nationkey end as int)",
        "Gemeente_naam": "n_name",
        "gemeente_nr_recent": f"cast(case n_nationkey when 24 then {codes.MUNICIPALITY_WITHOUT_UNIT}"
        " else n_nationkey - n_nationkey % 5 end as int)",
        "provincie": "cast(floor(n_nationkey / 5) as int)",
        "politie_regio": "cast(n_nationkey % 4 as int)",
        "eenheid": "cast(nullif(n_nationkey % 3, 2) as int)",
    },
)

POPULATION = StandIn(
    "lineitem",
    {
        "jaar": "cast(year(l_shipdate) - 20 as int)",
        "geslacht": "cast(l_linenumber % 3 as int)",
        "lft_inw": _age("l_partkey"),
        "gemeente_nr": _municipality("l_suppkey"),
        "aantal": "cast(nullif(l_quantity, 13) as bigint)",
    },
)

NEW_ACCIDENTS = StandIn(
    "orders",
    {
        "jaar": "cast(year(o_orderdate) - 11 as int)",
        "ernong5": "cast(nullif(o_orderkey % 7, 0) as int)",
        "PVrapp": "cast(o_custkey % 13 as int)",
        "key_gem": _municipality("o_custkey"),
        "wegbeh": "cast(o_orderkey % 6 as int)",
    },
)
OLD_ACCIDENTS = StandIn(
    "lineitem",
    {
        "Jaar": "cast(year(l_shipdate) - 11 as int)",
        "Ndood": "cast(nullif(l_linenumber - 1, 6) as int)",
        "gemeente_nr": _municipality("l_suppkey"),
        "wegbeh": "cast(l_partkey % 6 as int)",
    },
)
LATE_ACCIDENTS = StandIn(
    "customer",
    {
        "JAAR": "cast(92 + c_custkey % 2 as int)",
        "KEY_GEM": _municipality("c_custkey"),
        "WEGBEH": "cast(c_nationkey % 6 as int)",
        "NDOOD": "cast(c_nationkey % 2 as int)",
    },
)

NEW_CASUALTIES = StandIn(
    "lineitem",
    {
        "jaar": "cast(year(l_shipdate) - 11 as int)",
        "ernstsl": "cast(l_partkey % 12 as int)",
        "key_gem": _municipality("l_suppkey"),
        "ote_sl": "cast(nullif(l_partkey % 9, 8) as int)",
        "sexesl": "cast(nullif(l_linenumber % 4, 3) as int)",
        "lftsl": _age("l_orderkey"),
    },
)
OLD_CASUALTIES = StandIn(
    "orders",
    {
        "Jaar": "cast(year(o_orderdate) - 11 as int)",
        "ernstsl": "cast(o_orderkey % 12 as int)",
        "gemeente_nr": _municipality("o_custkey"),
        "VVM": "cast(o_custkey % 14 as int)",
        "lftsl": _age("o_custkey"),
        "sexesl": "cast(o_orderkey % 4 as int)",
    },
)
LATE_CASUALTIES = StandIn(
    "customer",
    {
        "VORNUM": "c_custkey",
        "KEY_OBJ": "cast(nullif(c_custkey % 4, 3) as int)",
        "ERNSTSL": "cast(c_custkey % 11 as int)",
        "KEY_GEM": _municipality("c_custkey"),
        "LFTSL": _age("c_custkey"),
        "SEXESL": "cast(c_nationkey % 3 as int)",
    },
)
LATE_OBJECTS = StandIn(
    "supplier",
    {
        "VORNUM": "s_suppkey",
        "KEY_OBJ": "cast(nullif(s_suppkey % 4, 3) as int)",
        "VVM": "cast(s_nationkey % 14 as int)",
    },
)

WEEKTIME = StandIn(
    "events",
    {
        "ernstsl": "cast(event_id % 12 as int)",
        "ote_sl": "cast(case when event_id % 19 = 0 then 32760 else event_id % 96 end as int)",
        "lftsl": _age("user_id"),
        "sexesl": "cast(nullif(event_id % 4, 0) as int)",
        "weekdag": ("dayofweek(ts)", "cast(dayofweek(ts) + 1 as int)"),
        "uur": "cast(case when event_id % 23 = 0 then null when event_id % 29 = 0 then 24 else hour(ts) end as int)",
        "botspartner": "cast(case when event_id % 5 = 0 then 32761 else user_id % 72 end as int)",
    },
)

STUDY_CASUALTIES = StandIn(
    "lineitem",
    {
        "jaar": "cast(1995 + l_orderkey % 7 as int)",
        "vornum": "cast(l_orderkey as string)",
        "wegbeh": "cast(nullif(l_orderkey % 5, 0) as int)",
        "loctypon": "cast(20 + l_orderkey % 3 as int)",
        "bebouw": "cast(l_orderkey % 2 as int)",
        "maxsne": "cast(case when l_linenumber = 7 then 30 when l_orderkey % 4 = 0 then null else 50 end as int)",
        "key_gem": "cast(l_orderkey % 27 as int)",
        "ernstsl": "cast(l_partkey % 12 as int)",
        "ote_sl": "cast(l_partkey % 96 as int)",
        "botspartner": "cast(case when l_suppkey % 9 = 0 then 32761 else l_suppkey % 95 end as int)",
        "vervoersw_detail": "cast(nullif(30 + l_partkey % 40, 35) as int)",
        "tegenpartij_detail": "cast(30 + l_suppkey % 50 as int)",
        "sexesl": "cast(l_linenumber % 3 as int)",
        "lftsl": _age("l_partkey"),
        "func": "cast(1 + l_linenumber % 3 as int)",
    },
)
STUDY_ACCIDENTS = StandIn(
    "orders",
    {
        "jaar": "cast(1995 + o_orderkey % 7 as int)",
        "vornum": "cast(o_orderkey as string)",
        "wegbeh": "cast(nullif(o_orderkey % 5, 0) as int)",
        "loctypon": "cast(20 + o_orderkey % 3 as int)",
        "bebouw": "cast(o_orderkey % 2 as int)",
        "maxsne": "cast(case when o_orderkey % 4 = 0 then null else 50 end as int)",
        "key_gem": "cast(o_orderkey % 27 as int)",
        "ernong5": "cast(1 + o_orderkey % 6 as int)",
        "datum": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
        "N_motor": "cast(nullif(o_custkey % 4, 3) as int)",
        "vervoersw_detail_A": "cast(30 + o_custkey % 20 as int)",
        "vervoersw_detail_B": "cast(nullif(30 + o_custkey % 30, 40) as int)",
        "gme_naam": "concat('Gemeente ', cast(o_orderkey % 27 as string))",
        "pve_naam": "case when o_orderkey % 27 < 18 then 'Zuid-Holland' else 'Zeeland' end",
    },
)

ROAD_CASUALTIES = StandIn(
    "lineitem",
    {
        "jaar": "cast(1995 + l_orderkey % 7 as int)",
        "vornum": "l_orderkey",
        "maxsne": "cast(case l_orderkey % 3 when 0 then 50 when 1 then 80 else null end as int)",
        "loctypon": "cast(nullif(20 + l_orderkey % 4, 23) as int)",
        "wegbeh": "cast(1 + l_orderkey % 4 as int)",
        "bebouw": "cast(nullif(1 + l_orderkey % 5, 5) as int)",
        "ernstsl": "cast(nullif((l_linenumber * 3 + l_orderkey) % 12, 11) as int)",
    },
)
ROAD_CATEGORIES = StandIn(
    "orders",
    {
        "jaar": "cast(1995 + case when o_custkey % 5 = 0 then 9 else o_orderkey % 7 end as int)",
        "vornum": "o_orderkey",
        "wegtype": "nullif(o_orderpriority, '5-LOW')",
        "n_slacht_dood": "cast(nullif(o_custkey % 4, 3) as bigint)",
        "ernong5": "cast(nullif(1 + o_orderkey % 6, 6) as int)",
    },
)

MODES = StandIn(
    "part",
    {
        "cob_code": "cast(p_partkey as int)",
        "cob_label": "nullif(p_type, 'STANDARD')",
        "hoofdgroep": "p_brand",
        "hoofdgroep_code": "cast(nullif(p_size % 7, 3) as int)",
    },
)

DELIVERIES = StandIn(
    "orders",
    {
        "prod_nr": "cast(nullif(o_custkey % 1000, 7) as int)",
        "lever_datum": "cast(case when o_orderkey % 11 = 0 then null else o_orderdate end as date)",
        "lever_nr": "o_orderkey",
        "lever_omschrijving": "nullif(o_orderpriority, '5-LOW')",
        "lever_archief": "o_orderstatus",
        "lever_periode": "cast(case when o_custkey % 3 = 0 then null else year(o_orderdate) end as int)",
        "lever_voorwaarde": "concat(o_orderstatus, '/', o_orderpriority)",
        "lever_bewaartermijn": "cast(o_orderkey % 10 as int)",
        "lever_IB_klasse": "cast(case when o_custkey % 4 = 0 then null else o_orderkey % 3 end as int)",
        "lever_IB_opvolging": "cast(nullif(o_orderkey % 5, 4) as int)",
    },
)

ORGANISATIONS = StandIn(
    "region",
    {
        "org_nr": "cast(r_regionkey as int)",
        "org_naam_kort": "case r_regionkey when 1 then 'Eurostat' when 3 then 'WHO' else r_name end",
    },
)
PRODUCTS = StandIn(
    "nation",
    {
        "prod_nr": "cast(nullif(n_nationkey, 3) as int)",
        "org_nr": "cast(case when n_nationkey % 8 = 7 then 50 + n_nationkey else nullif(n_regionkey, 4) end as int)",
        "prod_naam": "n_name",
        "prod_update": "cast(case n_nationkey % 7 when 0 then 0 when 1 then -1 when 2 then 90 when 3 then 365"
        " when 4 then 1000 when 5 then 10 else null end as int)",
        "prod_docu": "concat('docu ', n_name)",
        "prod_memo": "nullif(n_name, 'NATION_9')",
        "prod_beheerder": "concat('beheer ', cast(n_regionkey as string))",
    },
)
SOURCES = StandIn(
    "supplier",
    {"prod_nr": "cast(nullif(s_nationkey, 6) as int)", "dmx_nr": "cast(s_suppkey as int)"},
)
# table names that hold every marker of the overview, in both cases, or are missing
_NAME = (
    "concat(split_part('TRANS_,T_,weg_,REF_,TxRANS_,bck,COPY,tabel_,TABEL_', ',', cast(least(p_partkey % 25, 8) + 1 as int)),"
    " cast(p_partkey as string), case when p_partkey % 25 = 2 then '_old' else '' end)"
)
CATALOG = StandIn(
    "part",
    {
        "schema_id": "cast(case p_partkey % 4 when 0 then 1 when 1 then 5 when 2 then 5 else p_size % 2 + 5 end as int)",
        "name": _NAME,
        "modify_date": "cast('2024-05-06 07:08:09' as timestamp)",
        "type_desc": "p_type",
    },
)
PROFILE = StandIn(
    "part",
    {
        "schema": "case p_partkey % 4 when 0 then 'dbo' else 'Admin1' end",
        "dmx_naam": f"upper({_NAME})",
        "rijen": "cast(p_retailprice * 10 as bigint)",
        "kolommen": "cast(p_size as int)",
        "minY": "cast(case when p_partkey % 6 = 0 then null else 1950 + p_size end as int)",
        "maxY": "cast(case when p_partkey % 9 = 0 then null else 1960 + p_size end as int)",
    },
)
MATRICES = StandIn(
    "part",
    {
        "dmx_nr": "cast(p_partkey as int)",
        "dmx_naam": f"case when p_partkey % 10 = 9 then concat('alleen_', cast(p_partkey as string)) else {_NAME} end",
        "dmx_type": "cast(nullif(p_size % 5, 0) as int)",
        "dmx_omschrijving": "p_name",
        "dmx_pasop_nl": "p_brand",
    },
)

# the lookup data: one tall codebook, with broken text, unknown codes and a code that is no number
CODEBOOK_SQL = """
SELECT * FROM (VALUES
 (493, 'geslacht', '1', 'Man', 'Male'),
 (493, 'geslacht', '2', 'Vrouw', 'Female'),
 (493, 'geslacht', '3', 'Onbekend', 'Unknown'),
 (25, 'provincie', '0', 'Groningen', 'Groningen'),
 (25, 'provincie', '1', 'FryslÃ¢n', 'Fryslan'),
 (25, 'provincie', '2', 'Drenthe', 'Drenthe'),
 (25, 'provincie', '3', 'Overijssel', 'Overijssel'),
 (25, 'provincie', 'x', 'Kapot', 'Broken'),
 (305, '', '0', 'Noord', 'North'),
 (305, '', '1', 'FryslÃ¢n', 'Fryslan'),
 (305, '', '2', 'Oost', 'East'),
 (1655, 'arrondissement', '0', 'Eenheid Noord', 'Unit North'),
 (1655, 'arrondissement', '1', 'Eenheid Oost', 'Unit East'),
 (203, 'wegbeh', '0', 'Rijk', 'State'),
 (203, 'wegbeh', '1', 'Provincie', 'Province'),
 (203, 'wegbeh', '2', 'Gemeente', 'Municipality'),
 (203, 'wegbeh', '3', 'Spoorwegen', 'Railways'),
 (203, 'wegbeh', '4', 'Staatsbosbeheer', 'Forestry'),
 (551, 'vvm_ivo', '1', 'Auto/bestel', 'Car/van'),
 (551, 'vvm_ivo', '2', 'Fiets', 'Bicycle'),
 (551, 'vvm_ivo', '3', 'Motor', 'Motorcycle'),
 (551, 'vvm_ivo', '4', 'Overig', 'Other'),
 (916, '', '0', 'Auto', 'Car'),
 (916, '', '1', 'Bestelauto', 'Van'),
 (916, '', '2', 'Vrachtauto', 'Lorry'),
 (916, '', '3', 'Bus', 'Bus'),
 (916, '', '4', 'Motor/scooter', 'Motorcycle'),
 (916, '', '5', 'Snorfiets', 'Moped'),
 (916, '', '6', 'Lopen', 'Walking'),
 (916, '', '7', 'Bomen', 'Trees'),
 (916, '', '8', 'Fiets', 'Bicycle'),
 (0, 'leeftijd_4_75', '1', '0 - 4', '0-4'),
 (0, 'leeftijd_4_75', '2', '5 - 9', '5-9'),
 (0, 'leeftijd_4_75', '3', '10-14', '10-14'),
 (0, 'leeftijd_4_75', '4', '15-74', '15-74'),
 (0, 'leeftijd_4_75', '5', '75+', '75+'),
 (0, 'vervoer2', '0', 'Auto', 'Car'),
 (0, 'vervoer2', '1', 'Fiets', 'Bicycle'),
 (0, 'vervoer2', '2', 'Voetganger', 'Pedestrian'),
 (0, 'vervoer2', '3', 'Motor', 'Motorcycle'),
 (200, 'weekdag', '1', 'zondag', 'Sunday'),
 (200, 'weekdag', '2', 'maandag', 'Monday'),
 (200, 'weekdag', '3', 'dinsdag', 'Tuesday'),
 (200, 'weekdag', '4', 'woensdag', 'Wednesday'),
 (200, 'weekdag', '5', 'donderdag', 'Thursday'),
 (200, 'weekdag', '6', 'vrijdag', 'Friday'),
 (929, 'leeftijd_ivo2', '0', '0-14', '0 to 14'),
 (929, 'leeftijd_ivo2', '1', '15-17', '15 to 17'),
 (929, 'leeftijd_ivo2', '2', '18-24', '18 to 24'),
 (929, 'leeftijd_ivo2', '3', '25-59', '25 to 59'),
 (929, 'leeftijd_ivo2', '4', '60+', '60 plus'),
 (419, 'maand', '1', 'januari', 'January'),
 (419, 'maand', '2', 'februari', 'February'),
 (419, 'maand', '3', 'maart', 'March'),
 (419, 'maand', '4', 'april', 'April'),
 (419, 'maand', '12', 'december', 'December'),
 (556, 'prov_ivo', '0', 'FryslÃ¢n', ''),
 (556, 'prov_ivo', '1', 'Overyssel', ''),
 (556, 'prov_ivo', '2', 'Overyssel + Flevoland', ''),
 (556, 'prov_ivo', '3', 'Zeeland', ''),
 (264, 'sexe', '1', 'Man', 'Male'),
 (264, 'sexe', '2', 'Vrouw', 'Female'),
 (930, 'uur_ivo2', '0', '0 uur', '0 h'),
 (930, 'uur_ivo2', '3', '3 uur', '3 h'),
 (930, 'uur_ivo2', '17', '17 uur', '17 h')
) AS t(var_nr, var_naam, code, oms, omsgb)
"""

# class of the transport code, in the new and the old source
NEW_MODES_SQL = "SELECT * FROM (VALUES (0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 9)) AS t(OTE_ID, VVM_IVO)"
OLD_MODES_SQL = (
    "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8),"
    " (10, 99)) AS t(VVM, VVMSH)"
)


def codebook(spark: SparkSession) -> DataFrame:
    return spark.sql(CODEBOOK_SQL)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = codebook(spark)
    dimension = region_dimension(
        MUNICIPALITIES.read(spark, sf_dir),
        variable_lookup(book, "province"),
        variable_lookup(book, "police_region"),
        variable_lookup(book, "police_unit"),
    )
    return settle(dimension, "regions")


def codebook_sql(number: int, key: str, numeric: bool = True) -> str:
    code = "try_cast(code AS INTEGER)" if numeric else "code"
    return (
        f"SELECT {code} AS {key}, CASE oms WHEN 'FryslÃ¢n' THEN 'Fryslân' ELSE oms END AS oms, omsgb"
        f" FROM codebook WHERE var_nr = {number} AND {code} IS NOT NULL"
    )


# common table expressions for the SQL side
REGIONS_CTE = f"""
codebook AS ({CODEBOOK_SQL}),
municipality AS ({MUNICIPALITIES.sql}),
regions AS (
  SELECT o.gemeente_nr, o.gemeente_nr_recent, r.Gemeente_naam AS Gemeente_naam_recent, o.Gemeente_naam,
         p.oms AS Provincie, g.oms AS Politieregio, e.oms AS Eenheid
  FROM municipality o
  LEFT JOIN municipality r ON r.gemeente_nr = o.gemeente_nr_recent
  LEFT JOIN ({codebook_sql(25, 'k')}) p ON p.k = r.provincie
  LEFT JOIN ({codebook_sql(305, 'k')}) g ON g.k = r.politie_regio
  LEFT JOIN ({codebook_sql(1655, 'k')}) e ON e.k = r.eenheid
)
"""
