from .aggregate import (
    contingency,
    group_count,
    group_sum,
    last_per_group,
    reconcile,
    reshape_wide,
    rollups,
    rollups_tagged,
    same_total,
    weighted_count,
    wide_count,
)
from .intervals import interval_array, interval_label
from .joins import (
    attach,
    flag_present,
    full_merge,
    keep_keys,
    keep_many_keys,
    missing_from,
    with_summary,
)
from .lookup import codebook_lookup, codebook_slice, left_lookup, require_unique, successors
from .ranges import row_ranks, running_totals
from .sort import arrange
from .union import append, append_filled, two_periods
from .window import pack_years, running_total

__all__ = [
    "append",
    "append_filled",
    "arrange",
    "attach",
    "codebook_lookup",
    "codebook_slice",
    "contingency",
    "flag_present",
    "full_merge",
    "group_count",
    "group_sum",
    "interval_array",
    "interval_label",
    "keep_keys",
    "keep_many_keys",
    "last_per_group",
    "left_lookup",
    "missing_from",
    "pack_years",
    "reconcile",
    "require_unique",
    "reshape_wide",
    "rollups",
    "rollups_tagged",
    "row_ranks",
    "running_total",
    "running_totals",
    "same_total",
    "successors",
    "two_periods",
    "weighted_count",
    "wide_count",
    "with_summary",
]
