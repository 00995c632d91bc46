"""Registry of organisations, products, deliveries and tables, and the data overview."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    codes,
    first_match,
    lacks_code,
    lacks_prefix,
    lacks_text,
    literal,
    member,
    paste,
    period_text,
)
from ..operators import arrange, full_merge, left_lookup
from ..operators.aggregate import last_values
LAST_VALUES = ["lever_omschrijving", "lever_archief", "lever_voorwaarde", "lever_bewaartermijn"]


def delivery_summary(deliveries: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """One row per product: first and last delivery, last descriptions, periods, classes and count.

    A delivery without a date counts as the last one. ``tie_break`` decides between deliveries of one
    date; after it, the described values themselves do, so the outcome never depends on row order.
    """
    order = ["lever_datum", *tie_break, *LAST_VALUES]
    grouped = (
        deliveries.where("prod_nr IS NOT NULL")
        .groupBy("prod_nr")
        .agg(
            F.expr("min(lever_datum) AS EersteLevering"),
            F.expr("max(lever_datum) AS LaatsteLevering"),
            F.expr(f"{last_values(LAST_VALUES, order)} AS _last"),
            F.expr("min(lever_periode) AS p_min"),
            F.expr("max(lever_periode) AS p_max"),
            F.expr("max(lever_IB_klasse) AS lever_IBklasse"),
            F.expr("max(lever_IB_opvolging) AS lever_IBopvolging"),
            F.expr("count(1) AS lever_aantal"),
        )
    )
    periods = f"CASE WHEN p_min IS NOT NULL THEN {paste('p_min', 'p_max', sep=' tm ')} END"
    return grouped.selectExpr(
        "prod_nr",
        "EersteLevering",
        "LaatsteLevering",
        "_last.*",
        "lever_IBklasse",
        "lever_IBopvolging",
        "lever_aantal",
        f"{periods} AS lever_perioden",
    )


def system_tables(catalog: DataFrame) -> DataFrame:
    """Tables or views of the system catalogue with schema name; temporary ones are left out."""
    schema = first_match([(f"schema_id = {i}", name) for i, name in codes.SCHEMA_NAMES.items()])
    return catalog.where(f"schema_id <> {codes.TEMPORARY_SCHEMA}").selectExpr(
        "name AS dmx_naam",
        "to_date(modify_date) AS modify_date",
        "type_desc",
        "upper(name) AS Udmx_naam",
        f"{schema} AS schema_naam",
    )


def listed_tables(tables: DataFrame) -> DataFrame:
    """The same from a table list of the Spark catalogue."""
    return tables.selectExpr("tabelnaam AS dmx_naam", "dmx_naam AS Udmx_naam", "schema AS schema_naam")


def table_registry(tables: DataFrame, profile: DataFrame, matrices: DataFrame) -> DataFrame:
    """All tables, with their profile, merged with the described matrices.

    ``tables`` comes from :func:`system_tables` or :func:`listed_tables`, ``profile`` from the table
    profile, ``matrices`` has
    ``dmx_nr, dmx_naam, dmx_type`` and descriptions.
    """
    profiled = left_lookup(tables, profile, {"Udmx_naam": "dmx_naam", "schema_naam": "schema"})
    described = matrices.withColumn("dmx_naam", F.expr("upper(dmx_naam)"))
    merged = full_merge(profiled, described, "dmx_naam")
    return merged.withColumn("Udmx_naam", F.expr("upper(dmx_naam)"))


def update_frequency(days: str) -> str:
    """Class of the number of days between updates."""
    cases = [(f"{days} BETWEEN {lo} AND {hi}", label) for lo, hi, label in codes.UPDATE_FREQUENCIES]
    cases.append((f"{days} > {codes.LONGEST_YEARLY}", codes.MULTI_YEAR_FREQUENCY))
    return first_match(cases, literal(codes.OTHER_FREQUENCY))


def visible_tables(name: str) -> str:
    """Names that are shown: no working copies, backups or tests. A missing name is shown."""
    return " AND ".join(
        [
            lacks_prefix(name, *codes.HIDDEN_PREFIXES),
            lacks_text(name, *codes.HIDDEN_MARKERS),
            lacks_text(f"upper({name})", *codes.HIDDEN_MARKERS_ANY_CASE),
        ]
    )


def data_overview(
    organisations: DataFrame,
    products: DataFrame,
    summary: DataFrame,
    sources: DataFrame,
    registry: DataFrame,
    ordered: bool = True,
    store: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """One row per product and table, for all organisations, products and tables.

    ``summary`` comes from :func:`delivery_summary` and ``registry`` from :func:`table_registry`;
    ``sources`` links ``prod_nr`` to ``dmx_nr``. The merges run from the many side: links, then
    products, then organisations. A merge reads its inputs twice: pass ``store=settle`` to have what
    has a long history written first. Without it nothing runs or is written while the plan is built.
    """
    store = store or (lambda df, name: df)
    linked = full_merge(sources.select("prod_nr", "dmx_nr"), store(registry, "registry"), "dmx_nr")
    supplied = left_lookup(
        products.selectExpr("*", f"{update_frequency('prod_update')} AS Frequentie"), summary, "prod_nr"
    )
    merged = full_merge(store(linked, "links"), store(supplied, "products"), "prod_nr")
    merged = full_merge(merged, organisations, "org_nr")
    shown = (
        merged.where(visible_tables("dmx_naam"))
        .where(lacks_code("dmx_type", *codes.HIDDEN_MATRIX_TYPES))
        .where("dmx_naam IS NULL OR schema_naam <> 'dbo' OR dmx_naam = Udmx_naam")
    )
    if ordered:
        international = f"cast({member('org_naam_kort', codes.INTERNATIONAL_HOLDERS)} AS INT) AS Internat"
        keys = ["Internat", "org_naam_kort", "prod_naam", "dmx_naam"]
        shown = arrange(shown.selectExpr("*", international), *keys)
    return shown.selectExpr(
        "prod_naam AS Product",
        "org_naam_kort AS Bronhouder",
        "prod_beheerder AS Prod_beheerder",
        "prod_docu",
        "prod_memo",
        "Frequentie",
        "coalesce(lever_aantal, 0L) AS lever_aantal",
        "LaatsteLevering",
        "lever_voorwaarde",
        "lever_IBklasse",
        "lever_IBopvolging",
        "dmx_naam AS Tabel",
        f"{period_text('minY', 'maxY')} AS Periode",
        "dmx_omschrijving AS TabelOms",
        "rijen",
        "kolommen",
        "dmx_pasop_nl AS TabelPasop",
    )
