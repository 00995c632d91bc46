"""Look-up in a stored table of ranges, by binary search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literal


def interval_array(ranges: DataFrame, lo: str, hi: str, label: str, gaps: bool = False) -> DataFrame:
    """One row: the ranges in order, as an array of ``(lo, hi, label)``.

    The job fails on a range without a bound or with its bounds swapped, on ranges that overlap, and, unless ``gaps`` are
    allowed, on whole numbers between two ranges that belong to neither.
    """
    entry = f"struct(cast(`{lo}` AS BIGINT) AS lo, cast(`{hi}` AS BIGINT) AS hi, cast(`{label}` AS STRING) AS label)"
    one = ranges.agg(F.expr(f"sort_array(collect_list({entry})) AS r"))
    wrong = "exists(r, e -> e.lo IS NULL OR e.hi IS NULL OR e.lo > e.hi)"
    places = "if(size(r) > 1, sequence(1, size(r) - 1), array())"
    overlap = f"exists({places}, i -> r[i].lo <= r[i - 1].hi)"
    gap = f"exists({places}, i -> r[i].lo > r[i - 1].hi + 1)" if not gaps else "false"
    says = {wrong: "a range without bounds or with swapped ones", overlap: "ranges overlap", gap: "a gap between ranges"}
    cases = " ".join(f"WHEN {test} THEN raise_error({literal(message)})" for test, message in says.items())
    return one.selectExpr(f"CASE {cases} ELSE r END AS r")


def interval_label(
    df: DataFrame,
    value: str,
    ranges: DataFrame,
    name: str,
    lo: str = "lo",
    hi: str = "hi",
    label: str = "label",
    otherwise: str | None = None,
    gaps: bool = False,
) -> DataFrame:
    """Add the label of the range that holds ``value``; ``otherwise`` is an expression for values in no range.

    The ranges come as one array out of a subquery, which is computed once, and every row searches it by halving: no join,
    and as many steps as the logarithm of the number of ranges. A missing value lies in no range.
    """
    kept, x = [f"`{c}`" for c in df.columns], f"cast(`{value}` AS BIGINT)"
    middle = "(a.low + a.high) div 2"
    step = (
        f"if(a.low >= a.high, a, if(_r[{middle}].lo <= {x},"
        f" struct(int({middle}) + 1 AS low, a.high AS high), struct(a.low AS low, int({middle}) AS high)))"
    )
    steps = "sequence(1, int(ceil(log2(size(_r) + 1))) + 1)"
    found = f"aggregate({steps}, struct(0 AS low, size(_r) AS high), (a, i) -> {step}, a -> a.low) - 1"
    searched = df.withColumn("_r", interval_array(ranges, lo, hi, label, gaps).scalar())
    searched = searched.selectExpr(*kept, "_r", f"CASE WHEN `{value}` IS NOT NULL THEN {found} END AS _at")
    hit = f"_at >= 0 AND {x} <= try_element_at(_r, _at + 1).hi"
    return searched.selectExpr(*kept, f"CASE WHEN {hit} THEN try_element_at(_r, _at + 1).label ELSE {otherwise or 'NULL'} END AS `{name}`")
