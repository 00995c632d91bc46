"""Repeated passages by suffix arrays.

Every byte goes that lies in a string of ``length`` bytes which also starts earlier: in a document with a smaller key, or
before it in the same one. The work is cut into shards so that equal strings always meet:

1. The anchor of a start is the first of the smallest hashes of short grams in its string. Equal strings have equal
   anchors at equal places. The starts of one anchor are a stretch of text, in which no string comes twice. Stretches are compared by hash: copies of an earlier one go as
   they are, inside a task before anything moves and per anchor afterwards. An anchor whose stretches are all equal
   is done; strings under different anchors differ.
2. The other stretches (the ends of copied passages) are gathered by anchor in shards. A shard has its suffix
   array (Larsson-Sadakane: groups of suffixes equal so far are refined by the ranks of what follows, sorted
   groups are left alone) and its common prefixes (Kasai), computed for all its stretches side by side. Suffixes
   with ``length`` bytes in common are one string; all but its first place go.
3. An anchor with more stretches than a shard takes goes on in the next one: its strings are looked up by binary
   search in the sorted strings of the shards before. Beyond ``spread`` stretches it is dealt to several tasks,
   and their first places are merged by string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import no_clash, quoted, settled, whole_row

GRAM, PIECE, RUN = 24, 1 << 21, 96
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ANCHORS = "deal long, known boolean, anchor long, print long, d long, r long, run long"
FOUND = "kind int, anchor long, sub long, d long, r long, run long"
STRETCHES = "anchor long, sub long, d long, r long, run long, stretch binary"
REMOVED = "kind int, string binary, d long, r long, run long"
REMOVE, ASK, FIRST = 0, 1, 2
LAST_KEY = (1 << 63) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Rolling hashes of any part of a text, with powers kept between texts."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, text: np.ndarray) -> None:
        if len(self.up) <= len(text):
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(len(text) + PIECE // 8, b, np.uint64)]) for b in (self.base, self.inverse))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text + np.uint64(1)) * self.up[: len(text)], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[first]) * self.down[first])

    def grams(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def runs(text: np.ndarray, ends: np.ndarray, length: int, one: Hashes, two: Hashes):
    """Runs of starts with one anchor: (first start, starts, anchor, hash of the stretch); texts end at ``ends``."""
    gram = min(GRAM, length)
    one.read(text)
    two.read(text)
    grams = one.grams(gram)
    low, size, width = grams, 1, length - gram + 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    ok = np.ones(len(low), bool)
    for end in ends:
        ok[max(0, end - length + 1) : end] = False
    new = ok.copy()
    # the first of equal grams is the anchor: it changes as a smaller gram comes in, or as the anchor goes out
    new[1:] &= (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    last = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False))
    many = -(-(last - first + 1) // RUN)
    start = np.repeat(first, many) + RUN * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    count = np.minimum(RUN, np.repeat(last, many) + 1 - start)
    return start, count, low[start], two.of(start, start + count + length - 1) ^ count.astype(np.uint64)


def suffix_array(signs: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of the suffixes of many stretches: ``signs`` are 1 to 256, ``room`` the signs left in the stretch.

    A suffix ends with its stretch; equal suffixes stand in the order of their positions.
    """
    n = len(signs)
    padded = np.append(signs.astype(np.int64), np.zeros(7, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 512 + np.where(room > k, padded[k : n + k], 0)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known, longest = 7, int(room.max(initial=0))
    while known < longest:
        heads = np.flatnonzero(new)
        size = np.diff(np.r_[heads, n])
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        at = order[open_]
        after = np.where(room[at] > known, rank[np.minimum(at + known, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[open_] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
        known *= 2
    rank[order] = np.arange(n)
    return order, rank


def common_prefixes(signs: np.ndarray, room: np.ndarray, first: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By order, the signs a suffix has in common with the one before it.

    Kasai: one position further, at most one sign of the common prefix is lost. All stretches (which begin at ``first``)
    go forward together.
    """
    out, held = np.zeros(len(signs), np.int64), np.zeros(len(first), np.int64)
    at, size = first.copy(), room[first]
    live = np.arange(len(first))
    for step in range(int(size.max(initial=0))):
        live = live[size[live] > step]
        here = at[live] + step
        before = order[np.maximum(rank[here] - 1, 0)]
        limit = np.where(rank[here] > 0, np.minimum(room[here], room[before]), 0)
        h = np.minimum(np.maximum(held[live] - 1, 0), limit)
        grow = np.flatnonzero(h < limit)
        while len(grow):
            same = signs[here[grow] + h[grow]] == signs[before[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < limit[grow]]
        held[live] = h
        out[rank[here]] = h
    return out


def strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings at some positions, as values of fixed size."""
    if not len(at):
        return np.empty(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at]).view(f"S{length}").ravel()


def repeated(text: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of strings of ``length`` bytes in stretches of the given sizes, and the first place of the same string."""
    signs, first = text.astype(np.int16) + 1, np.cumsum(size) - size
    room = np.repeat(first + size, size) - np.arange(len(text))
    order, rank = suffix_array(signs, room)
    prefix = common_prefixes(signs, room, first, order, rank)
    whole = room[order] >= length
    heads = np.maximum.accumulate(np.where(whole & (prefix < length), np.arange(len(order)), -1))[whole]
    position, least = order[whole], np.full(len(order), len(order))
    np.minimum.at(least, heads, position)
    sort = np.argsort(position)
    return position[sort], least[heads][sort]


def packed(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start * 128 + count


def record(schema: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) if not isinstance(c, pa.Array) else c for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def repeats(docs: DataFrame, length: int = 100, shard: int = 4096, spread: int = 2048, by_hash: bool = True, key: str = "doc_id", text: str = "text", signs: bool = False) -> DataFrame:
    """One row per row of ``docs``: its columns, ``spans`` (first, end) of the bytes that go, in order, and the ``kept`` bytes.

    Copies of a stretch are known by its two hashes of 64 bits; with ``by_hash`` off, all stretches of an anchor that has
    several go through the suffix arrays and are compared byte by byte. The rows are the same.

    With ``signs`` a sign that loses some of its bytes goes whole: spans begin and end between signs.

    Texts are UTF-8 bytes; a missing one is empty. Rows without a key come after all others, and rows that share a key
    in the order of a hash of their text; rows with the same key and text are one document and get the same spans. An
    empty table gives no rows. A column of the table called spans or kept is an error.
    """
    if not 8 <= length <= 4096:
        raise ValueError("length: 8 to 4096 bytes")
    no_clash(docs, "spans", "kept")
    content = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    d = F.coalesce(F.col(quoted(key)).cast("long"), F.lit(LAST_KEY)).alias("d")
    rows = docs.select(d, F.xxhash64(content).alias("r"), content.alias("bytes"))

    def anchors(batches):
        one, two = Hashes(BASE), Hashes(OTHER)
        for batch in batches:
            keys, prints = (batch.column(c).to_numpy() for c in ("d", "r"))
            parts, found, held = [], [], 0
            for i, line in enumerate(batch.column("bytes")):
                line = line.as_py()
                for at in range(0, max(1, len(line) - length + 1), PIECE):
                    piece = line[at : at + PIECE + length - 1]
                    if len(piece) >= length:
                        parts.append((i, at, piece))
                        held += len(piece)
                    if held >= PIECE:
                        found.append(read(parts, one, two))
                        parts, held = [], 0
            if parts:
                found.append(read(parts, one, two))
            if not found:
                continue
            row, start, count, anchor, hashed = (np.concatenate(x) for x in zip(*found))
            anchor, hashed, row_d, row_r = anchor.view(np.int64), hashed.view(np.int64), keys[row], prints[row]
            sort = np.lexsort((start, row_r, row_d, hashed, anchor))
            anchor, hashed, row_d, row_r, start, count = (x[sort] for x in (anchor, hashed, row_d, row_r, start, count))
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (hashed[1:] != hashed[:-1])]
            # a row that repeats is one document
            same = np.r_[False, ~new[1:] & (row_d[1:] == row_d[:-1]) & (row_r[1:] == row_r[:-1]) & (start[1:] == start[:-1])]
            new |= not by_hash
            deal = np.where(new, anchor, row_d ^ row_r)
            run = packed(start, count)
            keep = np.flatnonzero(~same)
            whole = record(ANCHORS, deal, new, anchor, hashed, row_d, row_r, run)
            for k in range(0, len(keep), 1 << 16):
                yield whole.take(pa.array(keep[k : k + (1 << 16)]))

    def read(parts, one, two):
        buffer = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in parts])
        start, count, anchor, hashed = runs(buffer, ends, length, one, two)
        part = np.searchsorted(ends, start, side="right")
        begin = np.r_[0, ends[:-1]]
        row, at = np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts])
        return row[part], start - begin[part] + at[part], count, anchor, hashed

    def compare(batches):
        """Of sorted anchors: copies of a stretch go, and the stretches of an anchor with several are asked for."""
        last, count, waiting = None, 0, None  # the last row, and the stretches of its anchor so far; a single one waits
        for batch in batches:
            known = batch.column("known")
            lost = batch.filter(pc.invert(known))
            yield record(FOUND, *marks(REMOVE, lost.num_rows), *(lost.column(c) for c in ("d", "r", "run")))
            batch = batch.filter(known)
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("anchor", "print", "d", "r", "run")]
            if last is None:
                last = (now[0][0] ^ 1, 0, 0, 0, 0)
            anchor, hashed, *place = (np.r_[b, x] for b, x in zip(last, now))
            new_anchor = anchor[1:] != anchor[:-1]
            new = new_anchor | (hashed[1:] != hashed[:-1])
            other = np.logical_or.reduce([x[1:] != x[:-1] for x in place])
            new |= other & (not by_hash)
            lost = ~new & other
            yield record(FOUND, *marks(REMOVE, lost.sum()), *(x[1:][lost] for x in place))
            heads, groups = np.flatnonzero(new), int(new_anchor.sum())
            group = np.cumsum(new_anchor)[heads]
            total = np.bincount(group, minlength=groups + 1)
            total[0] += count
            index = np.arange(len(heads)) - np.searchsorted(group, group) + np.where(group == 0, count, 0)
            ask = total[group] > 1
            if waiting is not None and total[0] > 1:
                yield record(FOUND, [ASK], [last[0]], [0], *[[x] for x in waiting])
                waiting = None
            at = heads[ask]
            yield record(FOUND, np.full(len(at), ASK), now[0][at], index[ask] // spread, *(x[at] for x in now[2:]))
            count = int(total[-1])
            if groups:
                waiting = tuple(x[heads[-1]] for x in now[2:]) if count == 1 else None
            last = tuple(x[-1] for x in now)

    def cut(batches):
        """The stretches that were asked for, from the documents."""
        for batch in batches:
            lines, d_, r_ = batch.column("doc").field(text), batch.column("d"), batch.column("r")
            for i, asked in enumerate(batch.column("asked")):
                line, asked = content_of(lines[i]), asked.values
                anchor, sub, run = (asked.field(c) for c in ("anchor", "sub", "run"))
                stretches = [line[x >> 7 : (x >> 7) + (x & 127) + length - 1] for x in run.to_pylist()]
                yield record(STRETCHES, anchor, sub, pa.repeat(d_[i], len(run)), pa.repeat(r_[i], len(run)), run, stretches)

    def shards(batches):
        """Sorted stretches in tables of at most ``shard`` rows, each once; no table has two parts of one anchor."""
        held, keys, before = None, ("anchor", "sub", "d", "r", "run"), None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in keys]
            again = np.logical_and.reduce([np.r_[b, x][1:] == np.r_[b, x][:-1] for b, x in zip(before or [x[0] ^ 1 for x in now], now)])
            before = [x[-1] for x in now]
            new = pa.Table.from_batches([batch.filter(pa.array(~again))])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            while held.num_rows >= shard:
                n = until(held)
                yield held.slice(0, n)
                held = held.slice(n)
        while held is not None and held.num_rows:
            n = until(held)
            yield held.slice(0, n)
            held = held.slice(n)

    def until(table):
        anchor, sub = (table.column(c).to_numpy()[:shard] for c in ("anchor", "sub"))
        other = np.flatnonzero((anchor[1:] == anchor[:-1]) & (sub[1:] != sub[:-1]))
        return int(other[0]) + 1 if len(other) else len(anchor)

    def sort_out(batches):
        before, open_, seen = [], None, 0  # strings of the anchor that goes on, by shard
        for table in shards(batches):
            anchor, sub, row_d, row_r, run = (table.column(c).to_numpy() for c in ("anchor", "sub", "d", "r", "run"))
            stretches = table.column("stretch").to_pylist()
            size = np.fromiter(map(len, stretches), np.int64, len(stretches))
            bytes_, begin = np.frombuffer(b"".join(stretches), np.uint8), np.cumsum(size) - size
            position, lead = repeated(bytes_, size, length)
            where, gone = np.searchsorted(begin, position, side="right") - 1, lead != position
            number = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
            for k in sorted({0, int(number[-1])}):  # anchors in between begin and end here
                own = np.flatnonzero(number == k)
                name = (int(anchor[own[0]]), int(sub[own[0]]))
                if name != open_:
                    yield from finish(open_, seen, before)
                    before, open_, seen = [], name, 0
                seen += len(own)
                leads = position[(number[where] == k) & ~gone]
                said = strings(bytes_, leads, length)
                sort = np.argsort(said, kind="stable")
                leads, said = leads[sort], said[sort]
                known = np.zeros(len(leads), bool)
                for earlier, *_ in before:
                    known |= earlier[np.minimum(np.searchsorted(earlier, said), len(earlier) - 1)] == said
                gone |= np.isin(lead, leads[known])
                leads, said = leads[~known], said[~known]
                if len(leads):
                    at = np.searchsorted(begin, leads, side="right") - 1
                    before.append((said, row_d[at], row_r[at], (run[at] >> 7) + leads - begin[at]))
            at, where = position[gone], where[gone]
            split = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (where[1:] != where[:-1])][: len(at)])
            count, at, where = np.diff(np.r_[split, len(at)]), at[split], where[split]
            yield record(REMOVED, np.full(len(at), REMOVE), [b""] * len(at), row_d[where], row_r[where], packed((run[where] >> 7) + at - begin[where], count))
        yield from finish(open_, seen, before)

    def finish(open_, seen, before):
        """First places of the strings of an anchor that is dealt to several tasks."""
        if open_ is None or not (open_[1] or seen >= spread):
            return
        for said, row_d, row_r, start in before:
            values = pa.array([t.ljust(length, b"\0") for t in said.tolist()], pa.binary())
            yield record(REMOVED, np.full(len(start), FIRST), values, row_d, row_r, packed(start, np.ones(len(start), np.int64)))

    def merge(batches):
        """Of sorted first places of one string all but the first go."""
        last = None
        for batch in batches:
            again = []
            for value in batch.column("string").to_pylist():
                again.append(value in (b"", last))
                last = value
            yield batch.filter(pa.array(again, pa.bool_())).select(["d", "r", "run"])

    def strip(batches):
        """Documents without what goes."""
        for batch in batches:
            docs_, lines = batch.column("doc"), batch.column("doc").field(text)
            for at in range(0, batch.num_rows, 512):
                spans, kept = [], []
                some = batch.slice(at, 512)
                for line, lost in zip(lines.slice(at, 512), some.column("lost")):
                    line = content_of(line)
                    first, end = covered(lost.values.to_numpy(), length)
                    if signs:
                        first, end = whole_signs(line, first, end)
                    spans.append([{"first": int(a), "end": int(b)} for a, b in zip(first, end)])
                    kept.append(b"".join([line[a:b] for a, b in zip(np.r_[0, end].tolist(), np.r_[first, len(line)].tolist())]))
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([docs_.slice(at, 512), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc", "spans", "kept"])

    dealt = rows.mapInArrow(anchors, ANCHORS).repartition("deal").sortWithinPartitions("known", "anchor", "print", "d", "r", "run")
    found = settled(dealt.mapInArrow(compare, FOUND), "stretches")
    # the documents move once: both joins below need the same exchange. It is one of a join, so that adaptive execution
    # can split it where a row is repeated very often
    moved = docs.select(whole_row(docs).alias("doc"), d, F.xxhash64(content).alias("r"))
    asked = found.where(F.col("kind") == ASK).groupBy("d", "r").agg(F.collect_list(F.struct("anchor", "sub", "run")).alias("asked"))
    stretches = moved.join(asked.hint("shuffle_hash"), ["d", "r"]).mapInArrow(cut, STRETCHES)
    stretches = stretches.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "d", "r", "run")
    ends = stretches.mapInArrow(sort_out, REMOVED)
    ends = ends.repartition(F.when(F.col("kind") == FIRST, F.xxhash64("string")).otherwise(F.xxhash64("d", "r"))).sortWithinPartitions("string", "d", "r", "run")
    lost = ends.mapInArrow(merge, "d long, r long, run long").unionByName(found.where(F.col("kind") == REMOVE).select("d", "r", "run"))
    lost = lost.groupBy("d", "r").agg(F.collect_list("run").alias("lost"))
    all_ = moved.join(lost.hint("shuffle_hash"), ["d", "r"], "left").withColumn("lost", F.coalesce("lost", F.expr("array()")))
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
    out = all_.select("doc", "lost").mapInArrow(strip, T.StructType([all_.schema["doc"], T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]))
    return out.select("doc.*", "spans", "kept")


def marks(kind: int, n: int):
    return np.full(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)


def content_of(value: pa.Scalar) -> bytes:
    value = value.as_py()
    return value.encode() if isinstance(value, str) else value or b""


def covered(lost: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes under runs of starts, as spans (first, end) that do not touch."""
    lost = np.sort(lost)
    first, end = lost >> 7, np.maximum.accumulate((lost >> 7) + (lost & 127) + length - 1)
    return joined(first, end)


def joined(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans, those that touch as one."""
    new = np.r_[True, first[1:] > end[:-1]][: len(first)]
    return first[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]] if len(first) else end


def whole_signs(line: bytes, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans of UTF-8 bytes, widened to whole signs: a sign has up to three bytes after its first."""
    if not len(first):
        return first, end
    after = np.append((np.frombuffer(line, np.uint8) & 0xC0) == 0x80, False)
    for _ in range(3):
        first, end = first - (after[first] & (first > 0)), end + after[end]
    return joined(first, end)


def digest(found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and a hash of what is left of every row."""
    size = F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long")
    return found.select(
        F.col(quoted(key)),
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def stripped(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with texts without their repeated passages; a sign that lost some of its bytes goes whole.

    ``size``, where the table has it, is the new number of signs. Every row stays, also one with nothing left, whose
    text is empty.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    left = repeats(rows, length, key="key", text="text", signs=True).select("row", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    new = {text: F.col("text")} | ({size: F.length("text").cast(docs.schema[size].dataType)} if size in docs.columns else {})
    return left.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
