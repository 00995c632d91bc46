"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis it then
lies nearest to. A table joins ``hashes`` such hashes; a vector enters its own bucket and, as probes, those
of the runner-up axes. Members of a bucket are compared by exact cosine.

Equal vectors with equal labels are one member that carries its count, so copies never meet in a bucket. A
bucket beyond ``bucket`` members is cut into tiles, and each pair of tiles is a task of its own: no pair is left
out and none is written. A pair that shares several buckets counts in the first of them only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest_labels
from .storage import quoted, settled
from .vectors import common_size, matrix, sound, unit

PAIRS_AT_ONCE = 1 << 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, rng: np.random.Generator, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``best`` nearest signed axes of each row after one random rotation, and how far each falls behind the first."""
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :best]
    size = np.take_along_axis(x, order, axis=1)
    return order * 2 + (size < 0), np.abs(size[:, :1]) - np.abs(size)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers (rows, tables x probes) of unit vectors: the own bucket first, then the nearest others."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    rng, best = np.random.default_rng(seed), min(wide, probes)
    out = np.empty((n, tables * probes), np.int64)
    for t in range(tables):
        code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            axis, behind = axes(x, rng, best)
            code = (code[:, :, None] * (2 * wide) + axis[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + behind[:, None, :] ** 2).reshape(n, -1)
            pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, pick, axis=1), np.take_along_axis(cost, pick, axis=1)
        code = np.pad(code, ((0, 0), (0, probes - code.shape[1])), mode="edge")
        out[:, t * probes : (t + 1) * probes] = code * tables + t
    return out


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of bucket numbers, the smallest number that both rows hold."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for column in range(b.shape[1]):
        hit = (a == b[:, column : column + 1]).any(axis=1)
        out = np.where(hit, np.minimum(out, b[:, column]), out)
    return out


def linked(members: DataFrame, dim: int, cosine: float, tables: int, hashes: int, probes: int, bucket: int, seed: int) -> DataFrame:
    """For members (node, label, copies, vec): rows (node, root, n): links found in a bucket, and one that joins its group."""

    def hashed(batches):
        for batch in batches:
            x = unit(matrix(batch.column("vec"), dim))
            codes = buckets(x, tables, hashes, probes, seed)
            once = np.ones(codes.shape, bool)
            for c in range(1, codes.shape[1]):
                once[:, c] = ~(codes[:, :c] == codes[:, c : c + 1]).any(axis=1)
            row, col = np.nonzero(once)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            units = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
            take = pa.array(row)
            for k in range(0, len(row), 4096):
                some = take.slice(k, 4096)
                columns = [batch.column(c).take(some) for c in ("node", "label", "copies")]
                columns += [pa.array(codes[row[k : k + 4096], col[k : k + 4096]]), lists.take(some), units.take(some)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "copies", "code", "codes", "vec"])

    kind = members.schema["label"].dataType.simpleString()
    dealt = members.mapInArrow(hashed, f"node long, label {kind}, copies long, code long, codes array<long>, vec array<double>")
    narrow = members.mapInArrow(hashed, f"node long, label {kind}, copies long, code long, codes array<long>, vec array<double>").select("label", "code")
    hot = settled(narrow.groupBy("label", "code").count().where(F.col("count") > bucket), "hot")
    whole = F.lit(0)
    if hot.limit(1).count():
        dealt = dealt.join(hot, ["label", "code"], "left")
        tiles = F.ceil(F.col("count") / bucket)
        tile = F.pmod(F.xxhash64("node"), tiles)
        dealt = dealt.withColumn("own", F.coalesce(tile, whole)).withColumn("other", F.explode(F.coalesce(F.expr(f"sequence(0, ceil(count / {bucket}) - 1)"), F.expr("array(bigint(0))"))))
    else:
        dealt = dealt.withColumns({"own": whole.cast("long"), "other": whole.cast("long")})
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("count", "other")
    key = ["label", "code", "low", "high"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "own", "node").select(*key, "own", "node", "copies", "codes", "vec")

    def compare(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = held.combine_chunks()
            keys = np.stack([held.column(c).to_numpy() for c in key])
            edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            if edges[-1]:
                yield from groups(held.slice(0, edges[-1]), edges)
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from groups(held, np.array([0, held.num_rows]))

    def groups(rows, edges):
        x = matrix(rows.column("vec").combine_chunks(), dim)
        codes = np.asarray(rows.column("codes").combine_chunks().flatten().to_numpy()).reshape(len(x), -1)
        node, copies, own, code, low, high = (rows.column(c).to_numpy() for c in ("node", "copies", "own", "code", "low", "high"))
        count, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            middle = a + int(np.searchsorted(own[a:b], high[a])) if low[a] != high[a] else b

            def pairs(a=a, b=b, middle=middle):
                step = max(1, PAIRS_AT_ONCE // (b - a))
                for i in range(a, middle, step):
                    to = min(middle, i + step)
                    left, right = np.nonzero(x[i:to] @ x[(start := i if middle == b else middle) : b].T >= cosine)
                    left, right = left + i, right + start
                    ok = right > left
                    left, right = left[ok], right[ok]
                    mine = first_shared(codes[left], codes[right]) == code[a]
                    np.add.at(count, left[mine], copies[right[mine]])
                    np.add.at(count, right[mine], copies[left[mine]])
                    yield left - a, right - a

            root[a:b] = forest_labels(b - a, pairs()) + a
        hit = (count > 0) | (root != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[root[hit]]), pa.array(count[hit])], names=["node", "root", "n"])

    return dealt.mapInArrow(compare, "node long, root long, n long")


def near_vectors(
    df: DataFrame,
    cosine: float = 0.98,
    tables: int = 4,
    hashes: int = 2,
    probes: int = 4,
    bucket: int = 2048,
    seed: int = 7,
    key: str = "vec_id",
    vec: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Links between vectors of equal label whose cosine is ``cosine`` or more.

    One row per row of ``df``: key, n_links (other rows linked directly), component_id (smallest key reachable, its
    own included), kept (key = component_id). Rows whose vector is missing, empty, zero or not finite, and rows
    without a label, link with nothing: n_links 0, their own group. Rows without a key link like others, but name no
    group: component_id is null where no linked row has a key, and kept is false. Repeated rows link with
    each other; where they share a key, each of them is kept. Vectors of different lengths are an error.
    """
    rows = df.select(F.col(quoted(key)).alias("id"), F.col(quoted(label)).alias("label"), F.col(quoted(vec)).alias("vec"))
    good = rows.where(sound("vec") & F.col("label").isNotNull())
    dim = common_size(good, "vec")
    classes = good.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = settled(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = settled(linked(classes.select("node", "label", "copies", "vec"), dim or 1, cosine, tables, hashes, probes, bucket, seed), "links")
    group = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("node", "low", "copies").join(links, "node", "left").join(group, "node", "left")
    named = settled(named.withColumns({"root": F.coalesce("component", "node"), "n": F.coalesce("n", F.lit(0)) + F.col("copies") - 1}), "groups")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("node", "n", "component_id")
    named = classes.select("node", "label", "vec").join(named, "node").select("label", "vec", "n", "component_id")
    linking = good.join(named, ["label", "vec"]).select("id", F.col("n").alias("n_links"), "component_id")
    alone = rows.where(~F.coalesce(sound("vec") & F.col("label").isNotNull(), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linking.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))
