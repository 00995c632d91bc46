"""Approximate nearest neighbours through low-dimensional stable projections indexed by kd-trees.

Unit vectors are projected on a few Gaussian (2-stable) directions. The square of a projected distance, divided by
that of the true one, follows a chi-square law with as many degrees of freedom as there are directions. So a
search takes neighbours in the order of their projected distance from a kd-tree, verifies each by its true
cosine, and stops once a closer neighbour than the worst one held would be unlikely to lie this far out.

Vectors are dealt to shards of bounded size; each has its own tree, and answers all queries. Queries stream past
the tree, so a shard holds its vectors only. The best of all shards are merged by score.

Equal unit vectors are one point of a tree. It carries the ``k + 1`` smallest of their keys: no more can be among the
``k`` nearest of a row, which may be one of them itself.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import quoted
from .vectors import common_size, matrix, sound, unit

ROUNDING = 1e-12  # of a squared distance of unit vectors, and more


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value below which a chi-square variable with so many degrees of freedom falls with probability ``p``."""

    def below(x):
        # the upper tail: a term for every two degrees, on top of that of one degree where their number is odd
        half, rest = x / 2, math.erfc(math.sqrt(x / 2)) if degrees % 2 else 0.0
        for i in range(degrees // 2):
            a = i + degrees % 2 / 2
            rest += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        return 1 - rest

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class Tree:
    """A kd-tree over projected points: the widest axis is cut at its median until ``leaf`` points are left."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        low, high, spans, children = [], [], [], []
        open_ = [(0, len(points), -1)]
        while open_:
            a, b, parent = open_.pop()
            at, own = len(spans), points[self.order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            spans.append((a, b))
            children.append([])
            if parent >= 0:
                children[parent].append(at)
            if b - a > leaf:
                axis, middle = int((high[-1] - low[-1]).argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                open_ += [(a, a + middle, at), (a + middle, b, at)]
        self.low, self.high, self.spans, self.children = np.array(low), np.array(high), spans, children

    def leaves(self, point: np.ndarray):
        """Leaves (bound, first, end) by increasing bound: the least squared distance any of its points can have."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        bound = (gap * gap).sum(axis=1).tolist()
        heap = [(bound[0], 0)]
        while heap:
            least, at = heapq.heappop(heap)
            if self.children[at]:
                for child in self.children[at]:
                    heapq.heappush(heap, (bound[child], child))
            else:
                yield least, *self.spans[at]


def points(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``x`` that differ, which of them each kept id has, and the ``most`` smallest ids of each, in its order."""
    x = np.ascontiguousarray(x + 0.0)  # no negative zeros
    _, first, of = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    of = of[order]
    few = np.arange(len(of)) - np.searchsorted(of, of) < most
    return x[first], of[few], ids[order][few]


class Shard:
    """Unit vectors in the order of their tree, and the keys of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, way: np.ndarray, leaf: int, most: int):
        x, of, ids = points(ids, x, most)
        self.tree = Tree(x @ way, leaf)
        order, size = self.tree.order, np.bincount(of, minlength=len(x))
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.x, self.ids = x[order], ids[np.argsort(place[of], kind="stable")]
        self.first = np.r_[0, np.cumsum(size[order])]

    def search(self, query: np.ndarray, own: int, point: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest (id, cosine) that the stopping test lets it find."""
        best_id, best = np.empty(0, np.int64), np.empty(0)
        for least, a, b in self.tree.leaves(point):
            if len(best) == k and least > stop * (max(0.0, 2 - 2 * best[-1]) + ROUNDING):
                break
            # summed row by row: equal rows have equal bits in every shard, which a matrix product does not promise
            score = np.repeat((self.x[a:b] * query).sum(axis=1), np.diff(self.first[a : b + 1]))
            some = self.ids[self.first[a] : self.first[b]]
            ok = some != own
            if len(best) == k:
                ok &= score >= best[-1]
            if ok.any():
                best_id, best = np.concatenate([best_id, some[ok]]), np.concatenate([best, score[ok]])
                order = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[order], best[order]
        return best_id, best


def nearest(
    df: DataFrame,
    every: int = 50,
    k: int = 5,
    directions: int = 8,
    confidence: float = 0.98,
    shard: int = 16384,
    leaf: int = 64,
    seed: int = 11,
    key: str = "vec_id",
    vec: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest other rows, by cosine, of every row whose key is divisible by ``every``.

    Rows (query_id, rank from 1, vec_id, score), ties to the smaller key; fewer than ``k`` where there are fewer
    candidates. Vectors that are missing, empty, zero or not finite and rows without a key take no part. Rows that
    repeat a key count once, with the smallest of their vectors. An empty table gives no rows; vectors of different
    lengths are an error. ``confidence`` is the chance, for each true neighbour, not to be cut off by the stopping test.
    """
    rows = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vec)).alias("vec")).where(sound("vec") & F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    dim, total = common_size(rows, "vec"), rows.count()
    shards = max(1, -(-total // shard))
    way = np.random.default_rng(seed).standard_normal((max(1, dim), directions))
    stop = chi_square_quantile(confidence, directions)

    def answer(batches):
        held, at, ids, vecs = None, None, [], []
        for batch in batches:
            place, kind, id_ = (batch.column(c).to_numpy() for c in ("shard", "asks", "id"))
            edges = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(place)]):
                if place[a] != at:
                    held, at, ids, vecs = None, place[a], [], []
                x = matrix(batch.column("vec").slice(a, b - a), dim)
                if not kind[a]:
                    ids.append(id_[a:b])
                    vecs.append(x)
                    continue
                if not ids:  # a shard without vectors
                    continue
                if held is None:
                    held, vecs = Shard(np.concatenate(ids), unit(np.concatenate(vecs)), way, leaf, k + 1), []
                x, found = unit(x), []
                for q, point, name in zip(x, x @ way, id_[a:b]):
                    found.append((name, *held.search(q, name, point, k, stop)))
                size = [len(f[1]) for f in found]
                columns = [np.repeat([f[0] for f in found], size), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    # a task has one shard and a part of the queries; where shards are few, several tasks hold the same one
    slices = max(1, -(-2 * df.sparkSession.sparkContext.defaultParallelism // shards))
    copies, every_shard = (f"sequence(bigint(0), bigint({n - 1}))" for n in (slices, shards))
    own = F.pmod(F.xxhash64("id"), F.lit(shards).cast("long")).alias("shard")
    stored = rows.select(own, F.explode(F.expr(copies)).alias("slice"), F.lit(0).alias("asks"), "id", "vec")
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slices).cast("long")).alias("slice")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.expr(every_shard)).alias("shard"), part, F.lit(1).alias("asks"), "id", "vec")
    place = (F.col("shard") * slices + F.col("slice")).cast("int")
    dealt = stored.unionByName(asked).repartitionById(shards * slices, place).sortWithinPartitions("shard", "asks", "id")
    found = dealt.select("shard", "asks", "id", "vec").mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
