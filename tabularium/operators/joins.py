"""Joins. A missing key matches a missing key, unless asked otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str] | Mapping[str, str]


def key_pairs(on: Keys) -> dict[str, str]:
    """Left key to right key."""
    if isinstance(on, str):
        return {on: on}
    return dict(on) if isinstance(on, Mapping) else {k: k for k in on}


def _aside(name: str) -> str:
    return f"_key_{name}"


def _set_aside(right: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Rename the right keys, so that both sides of the join can be told apart by name."""
    return right.withColumnsRenamed({r: _aside(r) for r in pairs.values()})


def _matches(pairs: Mapping[str, str], null_safe: bool | Iterable[str]) -> Column:
    """Join condition; ``null_safe`` is True, False, or the left keys that may be missing."""
    safe = set(pairs) if null_safe is True else set(null_safe or ())
    return F.expr(" AND ".join(f"`{a}` {'<=>' if a in safe else '='} `{_aside(b)}`" for a, b in pairs.items()))


def attach(
    left: DataFrame,
    right: DataFrame,
    on: Keys,
    null_safe: bool | Iterable[str] = True,
    how: str = "left",
) -> DataFrame:
    """Join two event-sized tables; the right keys are dropped.

    Name only the keys that may be missing in ``null_safe`` when the inputs are bucketed or already
    shuffled on the others: a null-safe key is hashed in another form and needs a new shuffle.
    Both sides are shuffled on the keys; adaptive execution splits the partitions of a hot left key.
    """
    pairs = key_pairs(on)
    shared = {c.lower() for c in left.columns} & {
        c.lower() for c in right.columns if c not in pairs.values()
    }
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    out = left.join(_set_aside(right, pairs), _matches(pairs, null_safe), how)
    return out.drop(*[_aside(r) for r in pairs.values()])


def _distinct_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[f"`{n}` AS `{_aside(n)}`" for n in names]).distinct()


def keep_keys(df: DataFrame, keys: DataFrame, on: Keys, bounded: bool = False) -> DataFrame:
    """Rows whose key occurs in ``keys``. The keys are made distinct before they travel.

    Of keys that come out of an event table Catalyst cannot foresee how few they are: settle them
    first, and their known size decides between a broadcast and a shuffle. Pass ``bounded=True`` only
    for keys of a fixed set (municipalities, for one): they are then broadcast.
    """
    pairs = key_pairs(on)
    wanted = _distinct_keys(keys, list(pairs.values()))
    return df.join(F.broadcast(wanted) if bounded else wanted, _matches(pairs, True), "left_semi")


def keep_many_keys(df: DataFrame, keys: DataFrame, on: Keys, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows whose key occurs in ``keys``, for a key set that is too large to broadcast.

    The keys are stored, distinct and sound, with a range test on the first of them. That is the form for which Spark
    builds a Bloom filter of the keys at run time and tests the rows of ``df`` against it before they are shuffled, so only
    hits and false hits travel; the join after it is exact. It does so from ``spark.sql.optimizer.runtime.bloomFilter.
    applicationSideScanSizeThreshold`` bytes of ``df`` on, if the keys take less than ``...creationSideThreshold``.
    The range test also reaches the scan of ``df``, which skips row groups outside. A missing key matches a missing
    key; those few rows are added apart, as a null-safe key cannot be filtered.
    """
    pairs = key_pairs(on)
    stored = store(_distinct_keys(keys, list(pairs.values())), "keys")
    sound = " AND ".join(f"`{_aside(b)}` IS NOT NULL" for b in pairs.values())
    first = f"`{_aside(next(iter(pairs.values())))}`"
    low, high, absent = stored.agg(
        F.expr(f"min({first})"), F.expr(f"max({first})"), F.expr(f"count_if(NOT ({sound}))")
    ).first()
    wanted = stored.where(sound)
    if low is not None:
        wanted = wanted.where((F.expr(first) >= F.lit(low)) & (F.expr(first) <= F.lit(high)))
    hits = df.join(wanted, _matches(pairs, False), "left_semi")
    if not absent:
        return hits
    incomplete = " OR ".join(f"`{a}` IS NULL" for a in pairs)
    return hits.unionByName(df.where(incomplete).join(stored.where(f"NOT ({sound})"), _matches(pairs, True), "left_semi"))


def missing_from(df: DataFrame, other: DataFrame, on: Keys) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    pairs = key_pairs(on)
    return df.join(_distinct_keys(other, list(pairs.values())), _matches(pairs, True), "left_anti")


def flag_present(df: DataFrame, other: DataFrame, on: Keys, name: str = "present") -> DataFrame:
    """Add a flag that tells whether the key occurs in ``other``."""
    pairs = key_pairs(on)
    found = _distinct_keys(other, list(pairs.values())).selectExpr("*", "true AS _found")
    out = df.join(found, _matches(pairs, True), "left")
    return out.selectExpr(*[f"`{c}`" for c in df.columns], f"_found IS NOT NULL AS `{name}`")


def full_merge(many: DataFrame, few: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join on equally named keys, which come out merged; missing keys match each other.

    Planned as a left join of ``many`` plus the rows of ``few`` that found no partner. A full outer
    join cannot be broadcast and adaptive execution cannot split its hot keys; the left join can do
    both, and the second part needs only the distinct keys of ``many``. So pass the table that is
    larger, or repeats its keys, as ``many``. Both are read twice: settle a result with a long history
    first, which also tells the planner whether ``few`` is small enough to broadcast.
    """
    names = [on] if isinstance(on, str) else list(on)
    matched = attach(many, few, names)
    alone = missing_from(few, many, names)
    return matched.unionByName(alone, allowMissingColumns=True)


def with_summary(
    detail: DataFrame, summary: DataFrame, on: str | Sequence[str], bounded: bool = False
) -> DataFrame:
    """Details with the summary of their group next to them.

    The summary must hold one row per group. Pass ``bounded=True`` only when the number of groups
    has a fixed bound (calendar years of a date, for one): the summary is then broadcast and the
    details are not shuffled at all.
    """
    return attach(detail, F.broadcast(summary) if bounded else summary, on)
