from .accidents import accident_series, late_accidents
from .casualties import casualty_base, casualty_tables, late_casualties
from .deaths import deaths_by_class
from .dimensions import add_age_labels, mode_groups, region_dimension, variable_lookup
from .motorcycle import motorcycle_cases
from .population import municipality_count, population_base, population_cube, population_tables
from .profile import profile_catalog, profile_stored, profile_tables
from .registration import rate_table, rate_tables, rate_wide, reconcile_rates, yearly_rate
from .registry import data_overview, delivery_summary, listed_tables, system_tables, table_registry, update_frequency
from .roadtype import casualties_by_road_type, deaths_by_road, location_study, road_type_wide
from .weektime import weektime_class, weektime_table

__all__ = [
    "accident_series",
    "add_age_labels",
    "casualties_by_road_type",
    "casualty_base",
    "casualty_tables",
    "data_overview",
    "deaths_by_class",
    "deaths_by_road",
    "delivery_summary",
    "late_accidents",
    "late_casualties",
    "listed_tables",
    "location_study",
    "mode_groups",
    "motorcycle_cases",
    "municipality_count",
    "population_base",
    "population_cube",
    "population_tables",
    "profile_catalog",
    "profile_stored",
    "profile_tables",
    "rate_table",
    "rate_tables",
    "rate_wide",
    "reconcile_rates",
    "region_dimension",
    "road_type_wide",
    "system_tables",
    "table_registry",
    "update_frequency",
    "variable_lookup",
    "weektime_class",
    "weektime_table",
    "yearly_rate",
]
