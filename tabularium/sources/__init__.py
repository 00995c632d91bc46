from .catalog import catalog_columns, column_list, column_table, table_list
from .observed import write_preserving
from .scan import FOOTERS, footer_scan, scan, tagged, year_bounds, year_range
from .shared import settings, settle, shared_dir
from .sheets import read_sheet, sheet_table
from .sinks import chunk_summary, csv2_columns, read_csv2, write_chunks, write_csv2, write_dataset, write_exact_chunks
from .statements import parameter_scan, sql_scan, statement
from .years import merge_late, of_years, publish_counts, read_by_year, write_by_year

__all__ = [
    "FOOTERS",
    "catalog_columns",
    "chunk_summary",
    "column_list",
    "column_table",
    "csv2_columns",
    "footer_scan",
    "merge_late",
    "of_years",
    "parameter_scan",
    "publish_counts",
    "read_by_year",
    "read_csv2",
    "read_sheet",
    "scan",
    "settings",
    "settle",
    "shared_dir",
    "sheet_table",
    "sql_scan",
    "statement",
    "table_list",
    "tagged",
    "write_by_year",
    "write_chunks",
    "write_csv2",
    "write_dataset",
    "write_exact_chunks",
    "write_preserving",
    "year_bounds",
    "year_range",
]
