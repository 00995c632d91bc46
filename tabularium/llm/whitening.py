"""Whitening of vectors, from a scatter matrix that is exact.

Vectors are made integers. The distinct ones, less the smallest value of each dimension, are cut in bit planes; a plane
of 64 rows is one word. The number of rows in which bit ``a`` of one dimension and bit ``b`` of another are both set
is the popcount of the two planes' AND, and these counts weighted by two to the ``a + b`` add up to the cross
product of the dimensions. Tasks count, Spark adds; centring is done in integers of any size, so the covariance
is rounded once, before its eigenvectors are taken.

Only numbers per dimension and per pair of dimensions reach the driver, whatever the number of rows.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import quoted, settled

SCALE, SHIFT = 64, 1_000_000
ROWS_AT_ONCE = 4096
WHOLE = "decimal(38,0)"


def whole_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, x): the vectors that can be whitened, as integers. An entry too large for a long fails the job."""
    entries = F.col(quoted(vec)).cast("array<double>")
    wrong = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(quoted(key)).alias("key"), entries.alias("c")).where(entries.isNotNull() & ~F.coalesce(wrong, F.lit(True)))
    fits = F.forall("c", lambda c: F.abs(c) < 2.0**52)
    rows = rows.where(F.assert_true(fits, "a vector entry of 2 to the 52 or more").isNull())
    return rows.select("key", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def planes(x: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of integers of 0 and more as words of 64 rows, the dimension of each plane and its bit."""
    rows = -(-len(x) // 64) * 64
    dims = np.repeat(np.arange(len(bits)), bits)
    places = np.concatenate([np.arange(b) for b in bits]) if len(dims) else np.empty(0, np.int64)
    set_ = np.zeros((len(dims), rows), np.uint8)
    set_[:, : len(x)] = (x.T[dims] >> places[:, None]) & 1
    return np.packbits(set_, axis=1).view(np.uint64), dims, places


def scatter(x: np.ndarray, bits: list[int]) -> list[list[int]]:
    """Cross products of the columns of ``x`` (integers of 0 and more) as integers of any size, upper half."""
    words, dims, places = planes(x, bits)
    first = np.searchsorted(dims, np.arange(len(bits) + 1))
    out = [[0] * len(bits) for _ in bits]
    for i in range(len(bits)):
        for p in range(first[i], first[i + 1]):
            both = np.bitwise_count(words[p] & words[first[i] :]).sum(axis=1, dtype=np.int64)
            for j, bit, n in zip(dims[first[i] :].tolist(), places[first[i] :].tolist(), both.tolist()):
                out[i][j] += n << (int(places[p]) + bit)
    return out


def whitened(df: DataFrame, most: int = 16, least: float = 1e-12, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row per vector and component (from 1, by falling variance, up to ``most``) with the vector's whitened value.

    Columns: key, component, n (distinct vectors, which alone are fitted), deviation (sum over dimensions of
    (n * x - S) squared, S being the sum of the distinct ones, exact), whitened, explained (share of the total variance),
    identity_error (largest difference of the covariance of the whitened distinct vectors from the identity). The
    largest entry of a component is positive.

    Vectors that are missing or hold missing or non-finite entries are left out; repeated rows and rows without a key
    stay, and repeats weigh once in the fit. Components whose variance is not above ``least`` of the largest one have
    no unit variance to be scaled to and are left out, so equal vectors, a single one, empty ones and an empty table
    give no rows. Vectors of different lengths, entries of 2 to the 52 or more and deviations beyond a long
    are errors. Other columns are not read.
    """
    rows = whole_vectors(df, key, vec)
    fit = settled(rows.select("x").distinct(), "distinct-vectors")
    spread = fit.select(F.size("x").alias("dims"), F.posexplode("x").alias("dim", "v")).groupBy("dims", "dim")
    known = spread.agg(F.min("v"), F.max("v"), F.sum(F.col("v").cast(WHOLE)), F.count("*")).orderBy("dims", "dim").collect()
    dims = len(known)
    if len({r[0] for r in known}) > 1 or (known and known[0][5] != fit.count()):
        raise ValueError(f"vectors of different lengths: {sorted({r[0] for r in known} | {0})}")
    low, high, total = [r[2] for r in known], [r[3] for r in known], [int(r[4]) for r in known]
    n = known[0][5] if known else 0
    bits = [(h - a).bit_length() for a, h in zip(low, high)]

    def crossed(batches):
        sums = [[0] * dims for _ in range(dims)]
        for x in blocks(batches, dims):
            part = scatter(x - np.array(low), bits)
            sums = [[a + b for a, b in zip(s, p)] for s, p in zip(sums, part)]
        i, j = np.triu_indices(dims)
        values = pa.array([Decimal(sums[a][b]) for a, b in zip(i, j)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "product"])

    # as many rows as pairs of dimensions
    products = fit.mapInArrow(crossed, f"i int, j int, product {WHOLE}").groupBy("i", "j").agg(F.sum("product")).collect() if n else []
    shifted = [t - n * a for t, a in zip(total, low)]
    cov = np.zeros((dims, dims))
    for i, j, product in products:
        cov[i, j] = cov[j, i] = (n * int(product) - shifted[i] * shifted[j]) / (n * n)
    variance, axes = np.linalg.eigh(cov)
    variance, axes = variance[::-1], axes[:, ::-1]
    kept = int((variance[:most] > least * max(variance, default=0.0)).sum()) if n else 0
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)]) if kept else axes[:, :0]
    way = axes / np.sqrt(variance[:kept])
    most_off = sum(max((n * a - t) ** 2, (n * h - t) ** 2) for a, h, t in zip(low, high, total))
    if most_off >= 1 << 63:
        raise OverflowError("deviations of these vectors are beyond a long")

    def off(x: np.ndarray) -> np.ndarray:
        return n * x - np.array(total)

    # the covariance of what comes out, over the distinct vectors: means first, then centred products
    error = identity_error(fit, lambda x: off(x) / n @ way, n, dims, kept) if kept else 0.0
    share = variance[:kept] / math.fsum(np.diag(cov)) if kept else variance[:0]

    def answer(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                d = off(whole(part.column(1), dims))
                m = part.num_rows
                columns = [part.column(0).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m))]
                columns += [pa.array(np.full(m * kept, n)), pa.array(np.repeat((d * d).sum(axis=1), kept)), pa.array((d / n @ way).ravel())]
                columns += [pa.array(np.tile(share, m)), pa.array(np.full(m * kept, error))]
                yield pa.RecordBatch.from_arrays([c.cast(to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names)

    named = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType()}
    named |= {c: T.DoubleType() for c in ("whitened", "explained", "identity_error")}
    schema = T.StructType([rows.schema["key"], *[T.StructField(name, kind) for name, kind in named.items()]])
    out = rows.where(F.lit(kept > 0)).mapInArrow(answer, schema)
    return out.withColumnRenamed("key", key)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def blocks(batches, dims: int):
    """Blocks of rows of bounded size."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield whole(batch.column(0).slice(a, ROWS_AT_ONCE), dims)


def identity_error(fit: DataFrame, project, n: int, dims: int, kept: int) -> float:
    """Largest entry of the covariance of the projected vectors less the identity."""

    def summed(work, schema):
        def run(batches):
            total = None
            for x in blocks(batches, dims):
                part = work(project(x))
                total = part if total is None else total + part
            if total is not None:
                at = np.indices(total.shape, np.int32).reshape(total.ndim, -1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(total.ravel())], names=[c.split()[0] for c in schema.split(", ")])

        return fit.mapInArrow(run, schema)

    mean = np.zeros(kept)
    for i, value in summed(lambda y: y.sum(axis=0), "i int, value double").groupBy("i").agg(F.sum("value")).collect():
        mean[i] = value / n
    cov = np.zeros((kept, kept))
    centred = summed(lambda y: (y - mean).T @ (y - mean), "i int, j int, value double")
    for i, j, value in centred.groupBy("i", "j").agg(F.sum("value")).collect():
        cov[i, j] = value / n
    return float(np.abs(cov - np.eye(kept)).max())
