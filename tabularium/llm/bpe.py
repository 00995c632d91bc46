"""BPE encoding and decoding: a segment tree over the ranks of neighbouring pairs.

Leaf ``i`` of a tree holds the rank of the pair that starts at sign ``i`` of a pre-token and, below it, ``i`` itself;
every inner node holds the smaller of its two children. So the root is the leftmost pair of the lowest rank. A merge
changes the leaves of the pair, of its left neighbour and of the sign taken in, each in as many steps as the tree is
high, until the root says that no pair can be merged: a pre-token of a million signs takes n log n steps.

The trees of the short pre-tokens of a block are the rows of one matrix and take their merges together, each its own;
a long pre-token has a tree by itself. What a word becomes does not depend on its neighbours, so a task merges a
word once and looks it up after that, in a table of bounded size.
"""

from __future__ import annotations

import json
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .numbers import Numbers
from .storage import quoted
from .token_counts import ODD, SPACE, UNUSUAL, Rules

TEXT_AT_ONCE, DOCS_AT_ONCE, KNOWN_WORDS, KNOWN_IDS = 4 << 20, 8192, 400_000, 4_000_000
TREES_AT_ONCE, LONGEST_ROW = 8192, 64
PLACE_BITS = 40
PLACE, NO_PAIR = (1 << PLACE_BITS) - 1, (1 << 63) - 1


class Merges:
    """The merges of a vocabulary: the rank of a pair of ids and the id it makes."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        self.rank = {pair: rank << PLACE_BITS for rank, pair in enumerate(pairs)}
        self.made = made
        both = np.array(pairs, np.int64).reshape(-1, 2)
        both = both[:, 0] << 32 | both[:, 1]
        self.order = np.argsort(both, kind="stable")
        self.sorted, self.makes = both[self.order], np.array(made, np.int32)

    def keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of many pairs; an id of -1 is no sign."""
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)
        found = (self.sorted[at] == wanted) & (b >= 0)
        return np.where(found, self.order[at] << PLACE_BITS | place, NO_PAIR)


def merged_rows(signs: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids left of many short pre-tokens, one after another, and how many each has.

    Rows of ``signs`` end in at least one -1. The trees are rows of one matrix of keys; all rows that still have a
    pair take their root's merge at once, and the three leaves of each are carried up together.
    """
    n, width = signs.shape
    size = 1 << max(1, (width - 1).bit_length())
    place = np.arange(width)
    alive = place < sizes[:, None]
    right, left = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    tree = np.full((n, 2 * size), NO_PAIR)
    tree[:, size : size + width - 1] = merges.keys(signs[:, :-1], signs[:, 1:], place[:-1])
    for level in range(size.bit_length() - 2, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
    flat, rows = tree.ravel(), np.arange(n)
    while len(rows := rows[tree[rows, 1] != NO_PAIR]):
        root = tree[rows, 1]
        i = root & PLACE
        taken, before = right[rows, i], left[rows, i]
        after = right[rows, taken]
        signs[rows, i], right[rows, i], left[rows, after] = merges.makes[root >> PLACE_BITS], after, i
        alive[rows, taken] = False
        has = before >= 0
        tops = rows[has], before[has]
        at = np.concatenate([rows * (2 * size) + size + taken, rows * (2 * size) + size + i, tops[0] * (2 * size) + size + tops[1]])
        flat[at] = np.concatenate([np.full(len(rows), NO_PAIR), merges.keys(signs[rows, i], signs[rows, after], i), merges.keys(signs[tops], signs[tops[0], i[has]], tops[1])])
        start = np.concatenate([rows, rows, tops[0]]) * (2 * size)
        node = at - start
        for _ in range(size.bit_length() - 1):
            node >>= 1
            up = start + 2 * node
            flat[start + node] = np.minimum(flat[up], flat[up + 1])
    return signs[alive], alive.sum(axis=1)


class PairTree:
    """The tree of one long pre-token."""

    def __init__(self, signs: array, merges: Merges):
        self.signs, self.merges = signs, merges
        self.right = array("q", range(1, len(signs) + 1))
        self.left = array("q", range(-1, len(signs) - 1))
        self.size = 1 << max(0, (len(signs) - 2).bit_length())
        self.tree = tree = array("q", [NO_PAIR]) * (2 * self.size)
        for i in range(len(signs) - 1):
            tree[self.size + i] = self.key(i)
        for at in range(self.size - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def key(self, i: int) -> int:
        """Rank and place of the pair that starts at sign ``i``."""
        j = self.right[i]
        rank = self.merges.rank.get((self.signs[i], self.signs[j])) if j < len(self.signs) else None
        return NO_PAIR if rank is None else rank | i

    def put(self, i: int, key: int) -> None:
        tree, at = self.tree, self.size + i
        if i >= self.size:  # the last sign starts no pair
            return
        tree[at] = key
        while at > 1:
            least = min(tree[at], tree[at ^ 1])
            at >>= 1
            if tree[at] == least:
                break
            tree[at] = least

    def merged(self) -> array:
        """The ids left when no pair can be merged."""
        signs, left, right, n, made = self.signs, self.left, self.right, len(self.signs), self.merges.made
        while (root := self.tree[1]) != NO_PAIR:
            i = root & PLACE
            taken, before = right[i], left[i]
            signs[i], right[i] = made[root >> PLACE_BITS], right[taken]
            if right[i] < n:
                left[right[i]] = i
            self.put(taken, NO_PAIR)
            self.put(i, self.key(i))
            if before >= 0:
                self.put(before, self.key(before))
        out, at = array("i"), 0
        while at < n:
            out.append(signs[at])
            at = right[at]
        return out


class Encoder:
    """Ids of texts under one tokenizers file."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        model = read["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"a vocabulary with other rules than this operator has: {odd or model['type']}")
        if read["decoder"] is not None or read.get("post_processor") is not None:
            raise ValueError("only vocabularies without a decoder of their own and without added ends")
        self.rules, self.vocab, self.suffix = Rules(spec), model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.merges = Merges([(self.vocab[a], self.vocab[b]) for a, b in pairs], [self.vocab[a + b] for a, b in pairs])
        spelt = [self.rules.signs[b] for b in range(256)]
        if not all(sign in self.vocab and sign + self.suffix in self.vocab for sign in spelt):
            raise ValueError("a vocabulary without an id for every byte")
        self.inner, self.last = (np.array([self.vocab[sign + end] for sign in spelt], np.int32) for end in ("", self.suffix))
        # a line break stands between two words
        self.token = regex.compile(f"{self.rules.token.pattern}|\n")
        self.forget()

    def forget(self) -> None:
        """Start the table of known words anew: their numbers, and for each number where its ids are in ``flat``."""
        self.known, self.flat, self.ends = Numbers(), np.array([*self.special.values()], np.int32), np.arange(len(self.special) + 1)
        for word in self.special:
            self.known[word]

    def learn(self, words: list[str]) -> None:
        """Ids of new words, added to the table."""
        unusual = [i for i, w in enumerate(words) if UNUSUAL.search(w)]
        usual = np.delete(np.arange(len(words)), unusual)
        tokens = Numbers({"\n": 0})
        found = self.token.findall("\n".join([words[i] for i in usual]).lower())
        which = np.fromiter(map(tokens.__getitem__, found), np.int64, len(found))
        breaks = which == 0
        split = [[tokens[t] for t in self.rules.tokens(words[i])] for i in unusual]
        word = np.r_[usual[np.cumsum(breaks)[~breaks]] if len(usual) else usual, np.repeat(np.array(unusual, np.int64), [len(t) for t in split])]
        order = np.argsort(word, kind="stable")
        word, which = word[order], np.r_[which[~breaks], np.array([n for t in split for n in t], np.int64)][order]
        ids, ends = self.merged([*tokens])
        many = (ends[1:] - ends[:-1])[which]
        per_word = np.zeros(len(words), np.int64)
        np.add.at(per_word, word, many)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(per_word)])
        self.flat = np.concatenate([self.flat, spans(ids, ends[which], many)])

    def merged(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and where each ends: trees of like size are merged together."""
        raw = [token.encode() for token in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        signs = self.inner[data]
        signs[ends[1:] - 1] = self.last[data[ends[1:] - 1]]
        many, found = sizes.copy(), []
        height = np.frexp(np.maximum(sizes - 1, 0))[1]
        for h in np.unique(height[(sizes > 1) & (sizes <= LONGEST_ROW)]):
            some = np.flatnonzero((height == h) & (sizes > 1) & (sizes <= LONGEST_ROW))
            for a in range(0, len(some), TREES_AT_ONCE):
                part = some[a : a + TREES_AT_ONCE]
                rows = np.full((len(part), sizes[part].max() + 1), -1, np.int32)
                rows[np.arange(rows.shape[1]) < sizes[part][:, None]] = spans(signs, ends[part], sizes[part])
                ids, many[part] = merged_rows(rows, sizes[part], self.merges)
                found.append((part, ids))
        for i in np.flatnonzero(sizes > LONGEST_ROW):
            ids = PairTree(array("i", signs[ends[i] : ends[i + 1]].tobytes()), self.merges).merged()
            many[i] = len(ids)
            found.append((np.array([i]), np.frombuffer(ids, np.int32)))
        single = np.flatnonzero(sizes == 1)
        found.append((single, signs[ends[single]]))
        at = np.r_[0, np.cumsum(many)]
        out = np.empty(at[-1], np.int32)
        for part, ids in found:
            out[places(at[part], many[part])] = ids
        return out, at

    def parts(self, text: str) -> list[str]:
        """Words between white space, and special strings, in order."""
        out, at = [], 0
        for found in self.rules.special.finditer(text):
            out += [*self.plain(text[at : found.start()]), found.group()]
            at = found.end()
        return out + self.plain(text[at:])

    def plain(self, part: str) -> list[str]:
        return [w for w in SPACE.split(part) if w] if ODD.search(part) else part.split()

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and where each text ends."""
        if len(self.known) > KNOWN_WORDS or len(self.flat) > KNOWN_IDS:
            self.forget()
        before = len(self.known)
        numbers = [np.fromiter(map(self.known.__getitem__, self.parts(text)), np.int64) for text in texts]
        if len(self.known) > before:
            self.learn(list(islice(self.known, before, None)))
        which = np.concatenate(numbers)
        many = (self.ends[1:] - self.ends[:-1])[which]
        ids = spans(self.flat, self.ends[which], many)
        upto = np.r_[0, np.cumsum(many)]
        return ids, upto[np.cumsum([0, *map(len, numbers)])]


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def spans(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return flat[places(starts, sizes)]


def names_of(read: dict) -> dict[int, str]:
    ids = read["model"]["vocab"] | {t["content"]: t["id"] for t in read["added_tokens"]}
    return {i: name for name, i in ids.items()}


class Decoder:
    """Texts of ids under one tokenizers file without a decoder: the names of the tokens, with a space between two."""

    def __init__(self, spec: str):
        ids = names_of(json.loads(spec))
        self.known = np.zeros(max(ids, default=-1) + 2, bool)
        self.known[[*ids]] = True
        self.names = pa.array([ids.get(i, "") for i in range(len(self.known))], pa.string())

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of every list of ids; ids without a name are left out."""
        kept = self.known[np.clip(ids, -1, len(self.known) - 1)]
        if not kept.all():
            ids, ends = ids[kept], np.r_[0, np.cumsum(kept)][ends]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.names.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


def encode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row (key, ids array<int>) per row of ``docs``, with ``decoded`` also the text that the ids decode to.

    ``spec`` is the text of a tokenizers file with merges, white-space words and byte signs; one with other rules is an
    error. Ids are those of the library without added tokens; special strings in a text are one id each, as is its
    default. A missing or empty text has no ids and decodes to an empty text; rows without a key and repeated
    rows stay; very long texts and words are encoded whole; an empty table gives no rows. Other columns are not read.
    """

    def work(batches):
        encoder, decoder, own, texts, held = Encoder(spec), Decoder(spec) if decoded else None, [], [], 0
        for batch in batches:
            for id_, text_ in zip(batch.column(0), batch.column(1)):
                own.append(id_.as_py())
                texts.append(text_.as_py() or "")
                held += len(texts[-1])
                if held >= TEXT_AT_ONCE or len(own) == DOCS_AT_ONCE:
                    yield table_of(own, *encoder.encoded(texts), decoder)
                    own, texts, held = [], [], 0
        if own:
            yield table_of(own, *encoder.encoded(texts), decoder)

    def table_of(own, ids, ends, decoder):
        columns = [pa.array(own, kind), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
        if decoded:
            columns.append(decoder.texts(ids, ends))
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows_ = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    schema = T.StructType([rows_.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add("decoded", T.StringType())
    names, kind = schema.names, to_arrow_type(schema["key"].dataType)
    return rows_.mapInArrow(work, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, spec: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row (key, text) per row: what the library decodes the ids to, special tokens included.

    Ids that the vocabulary lacks are left out, as the library does; missing ids give an empty text. Rows without a
    key and repeated rows stay; an empty table gives no rows.
    """

    def work(batches):
        decoder = Decoder(spec)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = [[-1 if i is None else i for i in some or ()] for some in part.column(1).to_pylist()]
                flat = np.array([i for some in lists for i in some], np.int64)
                texts = decoder.texts(flat, np.cumsum([0, *map(len, lists)]))
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["key", "text"])

    rows_ = rows.select(F.col(quoted(key)).alias("key"), F.col(quoted(ids)).alias("ids"))
    return rows_.mapInArrow(work, T.StructType([rows_.schema["key"], T.StructField("text", T.StringType())])).withColumnRenamed("key", key)


def digest(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids of every row, and the digests of its ids and of the text they decode to."""
    return encoded.select(
        F.col(quoted(key)),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

