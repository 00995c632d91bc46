"""Materialising sequences in training order.

Sequences are numbered as they are read: partition by partition, after one count per partition. A keyed Feistel
network permutes the numbers; what falls outside their range is permuted again until it falls inside (cycle
walking), so every sequence has one global slot and every slot one sequence, and no table of the order exists.
Slots are cut into shards of equal size, and ranges of neighbouring shards are the tasks that write them. A shard is one
file of records of equal length, in the order of its slots: slot, key, part and size, the token ids, a line end. A
reader finds any slot by arithmetic and reads on from it. Ids take a fixed number of bytes: one, when a text's own bytes
are its ids, or as many as a vocabulary needs (see :func:`packed_ids`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from .storage import quoted


ROUNDS = 6
HEAD = np.dtype([("slot", "<i8"), ("key", "<i8"), ("part", "<i4"), ("size", "<i4")])
NO_KEY = -(1 << 63)
SHARDS_A_TASK = 4


def rounds(x: np.ndarray, half: int, seed: int, backward: bool) -> np.ndarray:
    """The Feistel network on numbers of twice ``half`` bits, or its inverse."""
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
    for key in keys[::-1] if backward else keys:
        if backward:
            left, right = right, left
        h = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left = left ^ ((h ^ (h >> np.uint64(32))) & mask)
        if not backward:
            left, right = right, left
    return left << shift | right


def permuted(x: np.ndarray, n: int, seed: int, backward: bool = False) -> np.ndarray:
    """Where numbers below ``n`` stand in the keyed order of all numbers below ``n``, or which numbers stand there."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    x = rounds(x.astype(np.uint64), half, seed, backward)
    while (far := x >= np.uint64(n)).any():
        x[far] = rounds(x[far], half, seed, backward)
    return x.astype(np.int64)


def record_size(length: int) -> int:
    return HEAD.itemsize + length + 1


def packed_ids(docs: DataFrame, ids: str = "ids", width: int = 2) -> DataFrame:
    """``docs`` with its column of token ids packed, ``width`` bytes each, the lowest first; missing lists stay missing.

    An id that is missing, negative or too large for ``width`` fails the job.
    """
    if width not in (1, 2, 4):
        raise ValueError("width: 1, 2 or 4 bytes")
    place, kind = docs.columns.index(ids), np.dtype(f"<u{width}")

    def pack(batches):
        for batch in batches:
            lists = batch.column(place)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False)
            if flat.null_count or (len(values) and not 0 <= values.min() <= values.max() <= np.iinfo(kind).max):
                raise ValueError(f"a token id that is no number of {width} bytes")
            sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()])
            ends = np.cumsum(np.r_[0, sizes]) * width
            lost = np.array([not x.is_valid for x in lists])
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(values.astype(kind).tobytes())]).cast(pa.binary())
            blobs = pa.compute.if_else(pa.array(lost), None, blobs)
            yield pa.RecordBatch.from_arrays([blobs if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    numbers = [str(i) for i in range(len(docs.columns))]
    kinds = [T.BinaryType() if i == place else f.dataType for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([T.StructField(*x) for x in zip(numbers, kinds)])
    return docs.toDF(*numbers).mapInArrow(pack, schema).toDF(*docs.columns)


def materialise(docs: DataFrame, path: str, length: int = 512, per_shard: int = 16384, seed: int = 5, key: str = "doc_id", text: str = "text") -> int:
    """Write the byte sequences of all texts in a keyed random order to ``path``; returns their number.

    A text, or binary column of packed ids, is cut every ``length`` bytes (a multiple of the bytes of an id); unused places
    of a record are 0. A missing or empty text has no sequence, a very long one as many as it needs; rows without a key and repeated rows are written like others. No sequences: no files.
    ``docs`` must give the same rows in the same partitions when it is read again, as files do; otherwise the job fails.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col(quoted(key)).cast("long"), F.lit(NO_KEY)).alias("key"), content.alias("bytes"))
    parts = F.ceil(F.octet_length("bytes") / F.lit(length)).cast("long")
    # a number per input partition, sent to each executor once
    counted = np.array(rows.groupBy(F.spark_partition_id()).agg(F.sum(parts)).collect(), np.int64).reshape(-1, 2)
    total = int(counted[:, 1].sum())
    if not total:
        return 0
    counts = np.zeros(int(counted[:, 0].max()) + 2, np.int64)
    counts[counted[:, 0] + 1] = counted[:, 1]
    starts = spark.sparkContext.broadcast(np.cumsum(counts))

    def place(batches):
        own, firsts = TaskContext.get().partitionId(), starts.value
        number, end = (int(firsts[min(at, len(firsts) - 1)]) for at in (own, own + 1))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys, lines = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, batch.num_rows, 1024):
                some = [x.as_py() for x in lines.slice(at, 1024)]
                size = np.fromiter(map(len, some), np.int64, len(some))
                many = -(-size // length)
                doc = np.repeat(np.arange(len(some)), many)
                part = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                used = np.minimum(length, size[doc] - part * length)
                if not len(doc):
                    continue
                if number + len(doc) > end:
                    raise RuntimeError("the input changed between two reads: settle it first")
                ids = np.zeros((len(doc), length), np.uint8)
                ids[np.arange(length) < used[:, None]] = np.frombuffer(b"".join(some), np.uint8)
                head = np.empty(len(doc), HEAD)
                head["slot"] = permuted(np.arange(number, number + len(doc)), total, seed)
                head["key"], head["part"], head["size"] = keys[at : at + 1024][doc], part, used
                number += len(doc)
                shard = head["slot"] // per_shard
                order = np.argsort(shard, kind="stable")
                whole = np.concatenate([head.view(np.uint8).reshape(len(doc), -1), ids], axis=1)[order]
                shard, cuts = np.unique(shard[order], return_index=True)
                blobs = [squeeze(x.tobytes()) for x in np.split(whole, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(blobs, pa.binary())], names=["shard", "blob"])
        if number != end:
            raise RuntimeError("the input changed between two reads: settle it first")

    def fill(batches):
        shard, records = None, None
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != shard:
                    if records is not None:
                        yield from out(shard, records)
                    shard, records = name, np.zeros((min(per_shard, total - name * per_shard), HEAD.itemsize + length), np.uint8)
                    records[:, :8] = 255
                new = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8).reshape(-1, HEAD.itemsize + length)
                records[np.ascontiguousarray(new[:, : HEAD.itemsize]).view(HEAD)["slot"].ravel() - shard * per_shard] = new
        if records is not None:
            yield from out(shard, records)

    def out(shard, records):
        slots = np.ascontiguousarray(records[:, :8]).view("<i8").ravel()
        if not np.array_equal(slots, np.arange(len(records)) + shard * per_shard):
            raise RuntimeError(f"shard {shard} lacks records")
        width = records.shape[1]
        for k in range(0, len(records), 2048):
            some = records[k : k + 2048]
            values = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * width).astype(np.int32)), pa.py_buffer(some.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(slots[k : k + 2048]), values], names=["shard", "slot", "value"])

    # ranges of shards: as many tasks as the shards need, and no two of them write the same one
    tasks = -(-total // (per_shard * SHARDS_A_TASK))
    dealt = rows.mapInArrow(place, "shard long, blob binary").repartitionById(tasks, F.expr(f"int(shard div {SHARDS_A_TASK})"))
    blobs = dealt.sortWithinPartitions("shard")
    filled = blobs.mapInArrow(fill, "shard long, slot long, value binary")
    # the writer puts one line end after each value, whatever bytes it has
    filled.sortWithinPartitions("shard", "slot").select("shard", F.col("value").cast("string")).write.partitionBy("shard").text(path)
    return total


def sequences(spark: SparkSession, path: str, length: int = 512, per_shard: int = 16384, first: int = 0) -> DataFrame:
    """Records from slot ``first`` on: slot, shard, key, part, size, ids (bytes). Shards before it are not read."""

    def split(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, record_size(length))
                for k in range(0, len(lines), 4096):
                    some = lines[k : k + 4096]
                    head = np.ascontiguousarray(some[:, : HEAD.itemsize]).view(HEAD).ravel()
                    ids = [bytes(x[:n]) for x, n in zip(some[:, HEAD.itemsize : -1], head["size"])]
                    key = pa.array(head["key"].astype(np.int64), mask=head["key"] == NO_KEY)
                    yield pa.RecordBatch.from_arrays([pa.array(head["slot"].astype(np.int64)), pa.array(np.full(len(some), shard)), key, pa.array(head["part"].astype(np.int32)), pa.array(head["size"].astype(np.int32)), pa.array(ids, pa.binary())], names=["slot", "shard", "key", "part", "size", "ids"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard long").load(path)
    files = files.where(F.col("shard") >= first // per_shard).select("shard", "content")
    return files.mapInArrow(split, "slot long, shard long, key long, part int, size int, ids binary").where(F.col("slot") >= first)


def ordered(docs: DataFrame, path: str, length: int = 512, per_shard: int = 16384, seed: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` in training order and read the shards back: slot, shard, offset, key, part, n_tokens, crc."""
    spark = docs.sparkSession
    if not materialise(docs, path, length, per_shard, seed, key, text):
        return spark.createDataFrame([], f"slot long, shard long, offset long, {key} long, part int, n_tokens int, crc long")
    read = sequences(spark, path, length, per_shard)
    offset = (F.col("slot") % per_shard) * record_size(length)
    return read.select("slot", "shard", offset.alias("offset"), F.col("key").alias(key), "part", F.col("size").alias("n_tokens"), F.crc32("ids").alias("crc"))
