"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settled


def forest_labels(n: int, pairs) -> np.ndarray:
    """Smallest position linked to each of ``n`` positions, over an iterable of (left, right) position arrays.

    Memory is one number a position and one chunk of pairs, so a dense group need not hold its pairs.
    """
    label = np.arange(n)
    for left, right in pairs:
        while len(left):
            a, b = label[left], label[right]
            open_ = a != b
            if not open_.any():
                break
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """One row (node, component) for every node of an edge; component is its smallest reachable node.

    Alternating large and small stars: every round hangs the neighbours of a node on their smallest one, with
    minima taken before rows move, so that a node with very many neighbours never meets in one task. Each
    round is a written table. Edges with a missing end and loops are left out; no edges give no rows.
    """
    edges = (
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
        .distinct()
    )
    edges, mark = settled(edges, "edges"), None
    for _ in range(rounds):
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not seen[0] or tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").selectExpr("v AS u", "m AS v")
        edges = settled(small.unionByName(low.selectExpr("u", "m AS v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = edges.selectExpr("u AS node", "v AS component")
    return leaves.unionByName(edges.selectExpr("v AS node", "v AS component").distinct())
