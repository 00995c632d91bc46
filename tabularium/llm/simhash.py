"""SimHash near-duplicates: fingerprints compared as vertical bit planes.

Every text has a 64-bit fingerprint. Distinct fingerprints meet in buckets that fix some of their bits: the
64 bits are cut into ``radius + 2`` parts, and two fingerprints at most ``radius`` bits apart agree on two of
the parts at least. A bucket beyond ``bucket`` members is cut again by its remaining bits (``radius + 1``
parts, one of which must agree), which ends by itself, as members are distinct. Nothing is left out.

Inside buckets, bit ``b`` of 64 members is one word. One member is compared with 64 others at a time by
carry-save counters of the differing bits, and a word is abandoned as soon as all its 64 exceed the radius.
A bucket gives each linked member one link to the smallest position it reaches, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, forest_labels
from .storage import quoted, settled, whole_row

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
WORDS_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number; 0 if it has no word."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start, last = (end - size + 1).tolist(), end.tolist()[min(shingle, len(words)) - 1 :]
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(last)
    for k in range(0, n, WORDS_AT_ONCE):
        some = b"".join([digest(line[i:j], seed) for i, j in zip(start[k : k + WORDS_AT_ONCE], last[k : k + WORDS_AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, fp) for every row of ``docs``; a missing text counts as an empty one."""

    def compute(batches):
        for batch in batches:
            texts = batch.column(1)
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("binary").alias("text"))
    return rows.mapInArrow(compute, T.StructType([rows.schema["key"], T.StructField("fp", T.LongType())])).withColumnRenamed("key", key)


def close_pairs(values: np.ndarray, group_end: np.ndarray, radius: int):
    """Position pairs (i, j), i < j < group_end[i], of values at most ``radius`` bits apart, chunk by chunk."""
    n = len(values)
    words = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    own = np.where(bits.T == 1, FULL, np.uint64(0))  # 64 x n: the member's bit, 64 times
    first = (np.arange(n) + 1) // 64
    many = np.maximum(0, (group_end - 1) // 64 - first + 1)
    many[group_end <= np.arange(n) + 1] = 0
    ends = np.cumsum(many)
    total, width = int(ends[-1]) if n else 0, radius.bit_length()
    for begin in range(0, total, WORDS_AT_ONCE):
        at = np.arange(begin, min(total, begin + WORDS_AT_ONCE))
        i = np.searchsorted(ends, at, side="right")
        w = first[i] + at - (ends[i] - many[i])
        counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
        over = np.zeros(len(at), np.uint64)
        for b in range(64):
            carry = planes[b, w] ^ own[b, i]
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if b % 8 == 7:
                live = over != FULL
                if not live.all():
                    i, w, over, counters = i[live], w[live], over[live], [c[live] for c in counters]
                    if not len(i):
                        break
        if not len(i):
            continue
        above, same = np.zeros(len(i), np.uint64), np.full(len(i), FULL)
        for c in reversed(range(width)):  # the counters as a number against the radius
            if radius >> c & 1:
                same &= counters[c]
            else:
                above, same = above | (same & counters[c]), same & ~counters[c]
        near = np.unpackbits((~(over | above)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, column = np.nonzero(near)
        left, right = i[row], w[row] * 64 + column
        ok = (right > left) & (right < group_end[left])
        yield left[ok], right[ok]


def parts(bits: list[int], n: int) -> list[int]:
    """``bits`` cut into ``n`` masks of nearly equal size."""
    return [sum(1 << int(b) for b in piece) for piece in np.array_split(bits, n) if len(piece)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = 3, bucket: int = 4096) -> DataFrame:
    """Links (a, b) that connect the distinct values of column fp as all pairs within ``radius`` bits would."""
    if not 0 < radius < 31 or bucket < 1 << radius + 1:
        raise ValueError("radius: 1 to 30 bits; bucket: 2 to the radius + 1 at least")

    def compare(batches):
        held = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in range(3)])
            held = now if held is None else np.concatenate([held, now], axis=1)
            whole = held.shape[1]
            while whole and (held[:2, whole - 1] == held[:2, -1]).all():
                whole -= 1
            # the last bucket may go on in the next batch
            if whole:
                yield from forest(held[:, :whole])
                held = held[:, whole:]
        if held is not None and held.shape[1]:
            yield from forest(held)

    def forest(rows):
        new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        edges = np.concatenate([[0], new, [rows.shape[1]]])
        size = np.diff(edges)
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return
        values, end = rows[2][keep], np.repeat(np.cumsum(size[size > 1]), size[size > 1])
        label = forest_labels(len(values), close_pairs(values.view(np.uint64), end, radius))
        linked = label != np.arange(len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], names=["a", "b"])

    masks = [x | y for x, y in combinations(parts(list(range(64)), radius + 2), 2)]
    level = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    found = []
    for _ in range(64):
        keyed = level.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        hot = settled(keyed.groupBy("mask", "part").count().where(F.col("count") > bucket), "hot")
        masks = sorted(r[0] & (1 << 64) - 1 for r in hot.select("mask").distinct().collect())  # a few hundred at most
        small = keyed.join(hot, ["mask", "part"], "left_anti") if masks else keyed
        dealt = small.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        found.append(dealt.mapInArrow(compare, "a long, b long"))
        if not masks:
            break
        finer = [F.when(F.col("mask") == signed(m), F.array(*[F.lit(signed(m | p)) for p in parts([b for b in range(64) if not m >> b & 1], radius + 1)])) for m in masks]
        level = keyed.join(hot, ["mask", "part"], "left_semi").select("fp", F.explode(F.coalesce(*finer)).alias("mask"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and group of every row: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    A missing or empty text has fingerprint zero and links like any other; repeated rows stay rows. A row without
    a key has a fingerprint and takes the group's smallest key, null if no row of the group has one. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    prints = settled(fingerprints(docs, shingle, key, text), "fingerprints")
    group = connected_components(links(prints, radius, bucket)).withColumnsRenamed({"node": "fp", "component": "root"})
    lowest = prints.groupBy("fp").agg(F.min(quoted(key)).alias("low")).join(group, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = settled(lowest, "groups")
    roots = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    named = lowest.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col(quoted(key)), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest key stays.

    Rows without a key come after all others; of rows with the same key (or none) the one with the smallest hash
    of all its columns stays. Columns are those of ``docs``.
    """
    rows = docs.select(whole_row(docs).alias("doc"), F.col(quoted(key)).alias("key"), F.xxhash64(*[F.col(quoted(c)) for c in docs.columns]).alias("hash"))
    named = rows.select(F.struct("key", "hash").alias("id"), F.col("doc").getField(text).alias("text"))
    prints = settled(fingerprints(named, shingle, "id").select("id.*", "fp"), "fingerprints")
    group = connected_components(links(prints, radius, bucket)).withColumnsRenamed({"node": "fp", "component": "root"})
    # rows that are equal throughout are counted, and one of them is taken at the end
    order = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    equal = prints.groupBy("key", "hash", "fp").agg(F.count("*").alias("equal"))
    first = equal.groupBy("fp").agg(F.min(F.struct(order.alias("order"), "equal")).alias("first"))
    first = first.join(group, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    first = settled(first.select("first.order.key", "first.order.hash", "first.equal"), "first")
    kept = rows.join(first.withColumnsRenamed({"key": "k", "hash": "h"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")))
    if first.where("equal > 1").limit(1).count():
        once = kept.where("equal > 1").dropDuplicates(["key", "hash"])
        kept = kept.where("equal = 1").unionByName(once)
    return kept.select("doc.*")
