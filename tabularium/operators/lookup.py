"""Codebook slices and label lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import label_map, literal, to_int
from .joins import Keys, attach, key_pairs


def codebook_slice(codebook: DataFrame, number: int | None = None, name: str | None = None) -> DataFrame:
    """Rows of one variable, found by number or by name (the name may be missing)."""
    wanted = {"var_naam": name, "var_nr": number}
    tests = [f"{col} = {literal(value)}" for col, value in wanted.items() if value is not None]
    if not tests:
        raise ValueError("give a variable number or a name")
    return codebook.where(" OR ".join(tests))


def codebook_lookup(
    codebook: DataFrame,
    number: int | None = None,
    name: str | None = None,
    label: str | None = None,
    label_en: str | None = None,
    numeric: bool = True,
    repairs: Mapping[str, str] | None = None,
) -> DataFrame:
    """One lookup: the key ``code``, as number or text, plus the wanted labels.

    The codebook columns are ``var_nr, var_naam, code, oms`` and, for the English label, ``omsgb``.
    Rows whose code is no number have a missing key in a numeric lookup and are left out, as no
    coded row can refer to them. The key keeps the name ``code`` because variables and their labels
    often differ in capitals only, which Spark does not tell apart.
    """
    rows = codebook_slice(codebook, number, name)
    cols = [f"{to_int('code') if numeric else 'code'} AS code"]
    for source, wanted in (("oms", label), ("omsgb", label_en)):
        if wanted is not None:
            cols.append(f"{label_map(source, repairs) if repairs else source} AS {wanted}")
    return rows.selectExpr(*cols).where("code IS NOT NULL")


def require_unique(ref: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``ref`` itself, but the job fails when a key occurs twice.

    A doubled key would silently multiply facts. The check is part of the plan: no extra job, and the
    grouping is spread over the cluster.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    columns = ref.columns
    values = [f"any_value(`{c}`) AS `{c}`" for c in columns if c not in names]
    grouped = ref.groupBy(*names).agg(*[F.expr(e) for e in ["count(1) AS _rows", *values]])
    message = literal(f"lookup key occurs twice: {', '.join(names)}")
    return grouped.where(f"assert_true(_rows = 1, {message}) IS NULL").select(*[f"`{c}`" for c in columns])


def left_lookup(
    fact: DataFrame,
    ref: DataFrame,
    on: Keys,
    null_safe: bool = False,
    unique: bool = True,
) -> DataFrame:
    """Add the columns of ``ref`` to every row of ``fact``; rows without partner keep missing values.

    ``on`` is a column name, a list, or a mapping from fact key to lookup key; the lookup keys are
    dropped. Pass ``null_safe=True`` for a lookup that has an entry for the missing key; others are
    compared plainly, which hashes faster and gives the same rows. ``unique=False`` skips the check of
    a lookup whose keys are unique by the way it was made.

    A lookup below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, a larger one is shuffled
    with hot keys split by adaptive execution.
    """
    pairs = key_pairs(on)
    checked = require_unique(ref, list(pairs.values())) if unique else ref
    return attach(fact, checked, pairs, null_safe)


def successors(areas: DataFrame, key: str, successor: str, suffix: str = "_recent") -> DataFrame:
    """Map every area, old or present, to its successor and the successor's attributes.

    ``areas`` holds one row per area with the number of its successor (itself, when it still exists).
    Own attributes other than the first column after the key are replaced by those of the successor.
    """
    own = [c for c in areas.columns if c not in (key, successor)]
    label, attributes = own[0], own[1:]
    present = areas.selectExpr(f"{key} AS {successor}", f"{label} AS {label}{suffix}", *attributes)
    return left_lookup(areas.select(key, label, successor), present, successor)
