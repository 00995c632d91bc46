"""SentencePiece encoding and decoding over a lattice of pieces.

The distinct stretches of a block of texts (a run of spaces and what follows it; no piece crosses its ends) are
exploded to their substrings of bounded length, which are joined with the piece table; what is found are the edges of
one lattice per stretch. A fold over each lattice gives its pieces:

* unigram vocabularies: Viterbi, the path of the highest sum of scores (of equal paths, not always the library's);
* BPE vocabularies: of two neighbouring pieces whose union is an edge, the pair of the highest score is joined, the
  leftmost of equals, until none is left. The best path is not what these vocabularies mean, and not what the
  library gives.

Stretches of equal length are folded together, as rows of a matrix. Signs without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import Numbers
from .storage import quoted

MARK = chr(0x2581)  # stands for a space
TEXT_AT_ONCE, KNOWN_STRETCHES, MATRIX_ROWS, MATRIX_WIDTH, LISTS_AT_ONCE = 2 << 20, 200_000, 4096, 48, 128
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20


@dataclass
class Pieces:
    """The piece table of a model file, with its hash join side."""

    names: list[str]
    scores: np.ndarray
    kinds: list[int]
    unigram: bool
    prefix: bool

    @classmethod
    def read(cls, model: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = [p.type for p in proto.pieces]
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or not proto.trainer_spec.byte_fallback:
            raise ValueError("only unigram and BPE vocabularies with byte pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or {*kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a vocabulary that changes texts, or with symbols of its user, is not supported")
        scores = np.array([p.score for p in proto.pieces], np.float32)
        return cls([p.piece for p in proto.pieces], scores, kinds, proto.trainer_spec.model_type == UNIGRAM, rules.add_dummy_prefix)

    def __post_init__(self):
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        self.bytes = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.bytes[int(self.names[i][1:-1], 16)] = i
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("a piece goes on after a space")
        self.longest = max(map(len, self.ids), default=1)
        inside = {sign for name in self.ids if len(name) > 1 for sign in name}
        alone = "".join(re.escape(s) for s in "\n\t" if s not in inside)  # ends a stretch, as no piece joins it
        ends = f"|[{alone}]" if alone else ""
        self.cuts = re.compile(f"[{alone}]" if alone else "(?!)").search
        self.stretch = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+{ends}")
        self.low = np.float32(min((self.scores[i] for i in self.ids.values()), default=0) - 10)
        self.keys, self.values = np.zeros((1 << SLOT_BITS) + 64, np.uint64), np.full((1 << SLOT_BITS) + 64, -1, np.int32)
        self.probes = 1
        for name, i in self.ids.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for sign in name:
                    h = (h + np.uint64(ord(sign) + 1)) * FACTOR
            at = int(h >> np.uint64(64 - SLOT_BITS))
            for probe in range(64):
                if not self.keys[at + probe]:
                    self.keys[at + probe], self.values[at + probe] = h, i
                    self.probes = max(self.probes, probe + 1)
                    break
            else:
                raise ValueError("piece table too dense")

    def units(self, line: str) -> list:
        """What a text is cut into: words after one space each, as they stand, or tuples of stretches."""
        if self.prefix and MARK not in line and "  " not in line and not line.startswith(" ") and not line.endswith(" "):
            return line.split(" ") if line else []
        line = MARK * (self.prefix and line != "") + line.replace(" ", MARK)
        return [(s,) for s in self.stretch.findall(line)]

    def parts(self, unit) -> list:
        """The stretches of a unit."""
        if not isinstance(unit, str):
            return unit
        return self.stretch.findall(MARK + unit) if self.cuts(unit) else (MARK + unit,)

    def join(self, h: np.ndarray) -> np.ndarray:
        """The pieces of substrings given by their hash, -1 where there is none."""
        at = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], -1)
        more = np.nonzero((key != h) & (key != 0))  # another piece has the slot: the next ones are tried
        for probe in range(1, self.probes):
            again = at[more] + probe
            hit = self.keys[again] == h[more]
            out[tuple(m[hit] for m in more)] = self.values[again[hit]]
        return out

    def edges(self, signs: np.ndarray) -> np.ndarray:
        """Pieces of all substrings: [row, start, length - 1], -1 for none."""
        rows, n = signs.shape
        out = np.full((rows, n, min(n, self.longest)), -1, np.int32)
        h, codes = np.zeros((rows, n), np.uint64), signs.astype(np.uint64) + np.uint64(1)
        for length in range(1, out.shape[2] + 1):
            h = (h[:, : n - length + 1] + codes[:, length - 1 :]) * FACTOR
            out[:, : n - length + 1, length - 1] = self.join(h)
        return out

    def merged(self, edges: np.ndarray) -> np.ndarray:
        """Lengths of the BPE symbols at their starts, 0 elsewhere."""
        rows, n, longest = edges.shape
        none = np.float32(-np.inf)
        score = np.append(self.scores, none)[edges]
        size, before = np.ones((rows, n + 1), np.int64), np.tile(np.arange(-1, n), (rows, 1))
        size[:, n] = 0
        worth = np.full((rows, n), none)  # of joining the symbol that starts here with the next one
        if longest > 1:
            worth[:, : n - 1] = score[:, : n - 1, 1]
        out, live = np.empty((rows, n), np.int64), np.arange(rows)
        while len(live):
            row, best = np.arange(len(live)), worth.argmax(axis=1)
            on = worth[row, best] > none
            if not on.all():
                out[live[~on]] = size[~on, :n]
                live, size, before, worth, score, best, row = live[on], size[on], before[on], worth[on], score[on], best[on], row[: on.sum()]
            middle = best + size[row, best]
            long = middle - best + size[row, middle]
            size[row, best], size[row, middle], worth[row, middle] = long, 0, none
            after, left = best + long, before[row, best]
            before[row, after] = best
            for start, both in ((best, long + size[row, after]), (left, long + size[row, left])):
                ok = (start >= 0) & (both > (long if start is best else 0)) & (both <= longest)
                value = np.where(ok, score[row, start, np.where(ok, both, 1) - 1], none)
                worth[row[start >= 0], start[start >= 0]] = value[start >= 0]
        return out

    def best_path(self, edges: np.ndarray) -> np.ndarray:
        """Lengths of the pieces of the best path at their starts, 0 elsewhere; of equal paths the longer last piece."""
        rows, n, longest = edges.shape
        padded = np.append(self.scores, np.float32(-np.inf))
        best, last = np.full((rows, n + 1), -np.inf, np.float32), np.zeros((rows, n + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            for length in range(min(end, longest), 0, -1):
                piece = edges[:, end - length, length - 1]
                score = padded[piece]
                if length == 1:
                    score = np.where(piece < 0, self.low, score)
                score = best[:, end - length] + score
                better = score > best[:, end]
                best[better, end], last[better, end] = score[better], length
        out, end, row = np.zeros((rows, n), np.int64), np.full(rows, n), np.arange(rows)
        while (open_ := end > 0).any():
            length = last[row, end]
            out[row[open_], (end - length)[open_]] = length[open_]
            end = end - np.where(open_, length, 0)
        return out

    def fold(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, one after another, and how many each has."""
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        counts, found = np.zeros(len(stretches), np.int64), []
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            if n > MATRIX_WIDTH:
                for i in own:
                    found.append((np.array([i]), self.one(stretches[i])))
                    counts[i] = len(found[-1][1])
                continue
            for k in range(0, len(own), MATRIX_ROWS):
                some = own[k : k + MATRIX_ROWS]
                signs = np.frombuffer("".join([stretches[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                edges = self.edges(signs)
                size = self.best_path(edges) if self.unigram else self.merged(edges)
                row, start = np.nonzero(size)
                piece = edges[row, start, size[row, start] - 1]
                if (piece < 0).any():
                    many = np.ones(len(piece), np.int64)
                    lost = np.flatnonzero(piece < 0)
                    own_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in signs[row[lost], start[lost]]]
                    many[lost] = list(map(len, own_bytes))
                    piece, row = np.repeat(piece, many), np.repeat(row, many)
                    piece[piece < 0] = [self.bytes[b] for x in own_bytes for b in x]
                found.append((some, piece))
                counts[some] = np.bincount(row, minlength=len(some))
        flat, start = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for some, piece in found:
            many = counts[some]
            flat[np.repeat(start[some] - (np.cumsum(many) - many), many) + np.arange(len(piece))] = piece
        return flat, counts

    def one(self, stretch: str) -> np.ndarray:
        """The same for one long stretch, without a matrix."""
        if self.unigram:
            best, last = [0.0] + [-np.inf] * len(stretch), [0] * (len(stretch) + 1)
            for start in range(len(stretch)):
                for end in range(start + 1, min(len(stretch), start + self.longest) + 1):
                    i = self.ids.get(stretch[start:end])
                    if i is None and end > start + 1:
                        continue
                    score = np.float32(best[start]) + (self.low if i is None else self.scores[i])
                    if score > best[end]:
                        best[end], last[end] = score, start
            cuts = [len(stretch)]
            while cuts[-1]:
                cuts.append(last[cuts[-1]])
            cuts.reverse()
        else:
            end, before = {i: i + 1 for i in range(len(stretch))}, {i: i - 1 for i in range(len(stretch) + 1)}
            heap = []

            def offer(start):
                if start in end and end[start] in end:
                    piece = self.ids.get(stretch[start : end[end[start]]])
                    if piece is not None:
                        heapq.heappush(heap, (-float(self.scores[piece]), start, end[start], end[end[start]]))

            for i in range(len(stretch)):
                offer(i)
            while heap:
                _, start, middle, last = heapq.heappop(heap)
                if end.get(start) != middle or end.get(middle) != last:
                    continue
                end[start] = last
                del end[middle]
                before[last] = start
                offer(start)
                if before[start] >= 0:
                    offer(before[start])
            cuts = [*sorted(end), len(stretch)]
        ids = []
        for a, b in zip(cuts, cuts[1:]):
            i = self.ids.get(stretch[a:b])
            ids += [i] if i is not None else [self.bytes[x] for x in stretch[a:b].encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32)


def gather(flat: np.ndarray, many: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the lists ``which``, one after another, and their numbers; list i has ``many[i]`` entries of ``flat``."""
    first, many = (np.cumsum(many) - many)[which], many[which]
    end = np.cumsum(many)
    return flat[np.repeat(first - (end - many), many) + np.arange(int(end[-1]) if len(end) else 0)], many


def encoder(model: bytes, place: int, names: list[str]):
    """Adds the ids of the texts in column number ``place`` to record batches."""

    def run(batches):
        pieces = Pieces.read(model)
        known, flat, ends = Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            at, texts = 0, batch.column(place)
            while at < batch.num_rows:
                stop, size, rows = at, 0, []
                if len(known) > KNOWN_STRETCHES:
                    known, flat, ends = Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64)
                new = len(known)
                while stop < batch.num_rows and (size < TEXT_AT_ONCE or stop == at):
                    line = texts[stop].as_py() or ""
                    size += len(line)
                    rows.append(np.fromiter(map(known.__getitem__, found := pieces.units(line)), np.int64, len(found)))
                    stop += 1
                parts = [pieces.parts(u) for u in islice(known, new, None)]
                more, counts = pieces.fold([s for part in parts for s in part])
                counts = np.add.reduceat(np.append(counts, 0), np.cumsum([0, *map(len, parts)])[:-1]) if parts else counts
                flat, ends = np.concatenate([flat, more]), np.concatenate([ends, ends[-1] + np.cumsum(counts)])
                out, many = gather(flat, np.diff(ends), np.concatenate(rows))
                offsets = np.concatenate([[0], np.cumsum(many)])[np.cumsum([0, *map(len, rows)])]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, stop - at).columns, lists], names=names)
                at = stop

    return run


def decoder(model: bytes, place: int, names: list[str]):
    """Adds the texts of the ids in column number ``place`` to record batches."""

    def run(batches):
        pieces = Pieces.read(model)
        said = [n.replace(MARK, " ").encode() if k == NORMAL else b"" if k == CONTROL else b" \xe2\x81\x87 " for n, k in zip(pieces.names, pieces.kinds)]
        for b, i in enumerate(pieces.bytes):
            said[i] = bytes([b])

        size = np.fromiter(map(len, said), np.int64, len(said))
        table = np.frombuffer(b"".join(said), np.uint8)

        def texts(lists: pa.Array) -> pa.Array:
            ids = lists.flatten()
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            owner = np.repeat(np.arange(len(lists)), many)
            plain = ids.fill_null(-1).to_numpy()
            wrong = (plain < 0) | (plain >= len(said))
            lost = np.bincount(owner[wrong], minlength=len(lists)) > 0
            lost |= lists.is_null().to_numpy(zero_copy_only=False)
            out, long = gather(table, size, np.where(wrong, 0, plain))
            per = np.bincount(owner, weights=long, minlength=len(lists)).astype(np.int64)
            if pieces.prefix:
                first = (np.cumsum(per) - per)[per > 0]
                first = first[out[first] == 32]
                out = np.delete(out, first)
                per[np.searchsorted(np.cumsum(per), first, side="right")] -= 1
            ends = np.r_[0, np.cumsum(per)]
            lines = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            try:
                lines = lines.cast(pa.string())
            except pa.ArrowInvalid:
                lines = pa.array([x.decode("utf-8", "replace") for x in lines.to_pylist()], pa.string())
            return pc.if_else(pa.array(lost), None, lines) if lost.any() else lines

        for batch in batches:
            for at in range(0, batch.num_rows, LISTS_AT_ONCE):
                some = batch.slice(at, LISTS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*some.columns, texts(some.column(place))], names=names)

    return run


def extended(df: DataFrame, work, name: str, kind: T.DataType) -> DataFrame:
    """``df`` with one more column that ``work`` gives; columns go by number meanwhile, whatever they are called."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    numbers = [str(i) for i in range(len(df.columns) + 1)]
    fields = [T.StructField(n, f.dataType) for n, f in zip(numbers, df.schema.fields)] + [T.StructField(numbers[-1], kind)]
    return df.toDF(*numbers[:-1]).mapInArrow(work(numbers), T.StructType(fields)).toDF(*df.columns, name)


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with one more column ``ids`` (array of int): the ids of the library for the model file ``model``.

    A missing or empty text has no ids. Rows and all other columns stay as they are; a column that already has the
    name of the new one is an error. An empty table gives an empty table.
    """
    place = docs.columns.index(text)
    return extended(docs, lambda names: encoder(model, place, names), ids, T.ArrayType(T.IntegerType()))


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with one more column ``text``: what the ids stand for.

    Bytes that are no UTF-8 become U+FFFD, begin and end marks nothing, the unknown piece its sign. A missing list, and
    a list with a missing id or one outside the vocabulary, give a missing text. Other columns stay.
    """
    place = df.columns.index(ids)
    return extended(df, lambda names: decoder(model, place, names), text, T.StringType())


def encoded_rows(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_ids, ids and whether decoding gives the text back (a missing one: as empty), for every row of ``docs``.

    Repeated rows and rows without a key are encoded each, very long texts whole; an empty table gives no rows.
    """
    into, back = encoder(model, 1, ["key", "text", "ids"]), decoder(model, 2, ["key", "text", "ids", "decoded"])

    def run(batches):
        for batch in back(into(batches)):
            key_, line, ids, decoded = batch.columns
            yield pa.RecordBatch.from_arrays([key_, pc.list_value_length(ids).cast(pa.int64()), ids, pc.equal(line, decoded)], names=["key", "n_ids", "ids", "exact"])

    rows = docs.select(F.col(quoted(key)).alias("key"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    kinds = {"n_ids": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "exact": T.BooleanType()}
    schema = T.StructType([rows.schema["key"], *[T.StructField(name, kind) for name, kind in kinds.items()]])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
