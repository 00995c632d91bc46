"""Checked queries: every operator and plan on the test tables, next to SQL that gives the same rows.

The private source tables of the published figures are not available, so :mod:`.standins` derives
tables of the same shape, with missing values and unknown codes, from the test tables.
"""

from . import basics, groups, jobs, lookups, outputs, recodes, registry, stored
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basics", "groups", "jobs", "lookups", "outputs", "recodes", "registry", "stored"]
