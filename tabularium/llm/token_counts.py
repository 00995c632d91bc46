"""Token counts of texts under a word-level BPE vocabulary, without making token ids.

A text is a bag of pre-tokens, and the number of pieces of a pre-token never depends on its neighbours. So tasks
turn blocks of documents into postings (pre-token: which documents of the block hold it, how often). Postings of
the same pre-token come together, its pieces are counted once, and the count times the frequencies is summed
per document. Blocks in groups of ``SPAN`` are dealt apart, so that even a pre-token of all documents is bounded
work in a task; what a task holds is a block of documents, or the sums of a few blocks.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbers import Numbers
from .storage import quoted

BLOCK_BYTES, BLOCK_DOCS, SPAN, SUMS_HELD = 32 << 20, 1 << 16, 256, 64
#: A block's own row has the word "", and as ``docs`` its keys, which of them are missing, sizes and special tokens.
POSTINGS = "word string, block long, docs binary, times binary"
SUMS = "block long, own boolean, docs binary, sums binary"
#: Signs that Python's split() takes for white space and the vocabulary's rules don't.
ODD = re.compile("[\x1c-\x1f]")
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = re.compile(f"[{''.join(map(chr, WHITE))}]+")
#: From here on signs can compose or lie in classes that depend on the Unicode version: left to the library.
UNUSUAL = re.compile(f"[{chr(0x250)}-{chr(0x10FFFF)}]")


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Rules:
    """The rules of one tokenizers file: white space, pre-tokens and pieces."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        read = json.loads(spec)
        split, level = read["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in read["normalizer"]["normalizers"]]
        replaced = [(x["pattern"], x["content"]) for x in read["normalizer"]["normalizers"] if x["type"] == "Replace"]
        if steps != ["NFC", "Replace", "Lowercase"] or replaced != [({"Regex": r"\s+"}, " ")] or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"]:
            raise ValueError("a vocabulary with other rules for words than this operator has")
        added = read["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("a vocabulary with special tokens that take in their neighbourhood")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        self.token = regex.compile(split["pattern"]["Regex"])
        self.signs = byte_signs()

    def words(self, text: str) -> tuple[list[str], int]:
        """Stretches between white space, and the number of special tokens, which split the text as they stand."""
        found, extra = [], 0
        parts = self.special.split(text)
        for part in parts:
            found += SPACE.split(part) if ODD.search(part) else part.split()
        return found, len(parts) - 1

    def tokens(self, word: str) -> list[str]:
        if UNUSUAL.search(word):
            whole = self.library.normalizer.normalize_str(word)
            return [whole[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        return self.token.findall(word.lower())

    def pieces(self, token: str) -> int:
        return len(self.library.model.tokenize(token.encode().decode("latin-1").translate(self.signs)))


def token_counts(docs: DataFrame, spec: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``spec`` is the text of a tokenizers file. Counts are those of the library without added tokens; special strings
    in a text are one token each, as is its default. A missing text counts as an empty one (no bytes, no
    tokens); rows without a key and repeated rows stay; an empty table gives no rows. Other columns are not read.
    """

    def postings(batches):
        rules, part, blocks = Rules(spec), TaskContext.get().partitionId(), 0
        raw, ids, sizes, extra, which, times, total = Numbers(), [], [], [], [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for id_, words, size in zip(batch.column(0).to_pylist(), texts, pc.binary_length(texts).to_pylist()):
                found, special = rules.words(words.as_py() or "")
                bag = Counter(found)
                bag.pop("", None)
                ids.append(id_)
                sizes.append(size or 0)
                extra.append(special)
                which.append(np.fromiter(map(raw.__getitem__, bag), np.int32, len(bag)))
                times.append(np.fromiter(bag.values(), np.int32, len(bag)))
                total += size or 0
                if total >= BLOCK_BYTES or len(ids) == BLOCK_DOCS:
                    yield from block(rules, (part << 24) + blocks, raw, ids, sizes, extra, which, times)
                    raw, ids, sizes, extra, which, times, total = Numbers(), [], [], [], [], [], 0
                    blocks += 1
        if ids:
            yield from block(rules, (part << 24) + blocks, raw, ids, sizes, extra, which, times)

    def block(rules, number, raw, ids, sizes, extra, which, times):
        tokens, parts = Numbers(), []
        for word in raw:
            parts.append([tokens[t] for t in rules.tokens(word)])
        many = np.fromiter(map(len, parts), np.int32, len(parts))
        flat = np.fromiter((t for p in parts for t in p), np.int32, int(many.sum()))
        start = (np.cumsum(many) - many).astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(w) for w in which])
        which, times = np.concatenate(which), np.concatenate(times)
        n = many[which]
        inside = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        inside += np.repeat(start[which], n)
        del which
        both = flat[inside].astype(np.int64)
        both *= len(ids)
        both += np.repeat(doc, n)
        times = np.repeat(times, n)
        del inside, doc, n
        order = np.argsort(both, kind="stable")
        both, times = both[order], times[order]
        del order
        first = np.flatnonzero(np.diff(both, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        both = both[first]
        often = -(-times // 255)  # a frequency is one byte; a larger one is several entries
        both = np.repeat(both, often)
        rest = np.full(len(both), 255)
        rest[np.cumsum(often) - 1] = times - 255 * (often - 1)
        token, doc = both // len(ids), both % len(ids)
        ends = np.searchsorted(token, np.arange(len(tokens) + 1)).astype(np.int32)
        docs_ = pa.BinaryArray.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(2 * ends), pa.py_buffer(doc.astype("<u2"))])
        times_ = pa.BinaryArray.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ends), pa.py_buffer(rest.astype(np.uint8))])
        words = pa.array(list(tokens), pa.string())
        for k in range(0, len(tokens), 8192):
            m = min(8192, len(tokens) - k)
            yield pa.RecordBatch.from_arrays([words.slice(k, m), pa.array(np.full(m, number)), docs_.slice(k, m), times_.slice(k, m)], names=names(POSTINGS))
        own = np.array([[i or 0 for i in ids], [i is None for i in ids], sizes, extra], "<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([number]), pa.array([own]), pa.array([b""])], names=names(POSTINGS))

    def count(batches):
        rules, last, pieces, held = Rules(spec), None, 0, {}
        for batch in batches:
            head = pc.equal(batch.column("word"), "")
            rows = batch.filter(head)
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("block"), pa.array([True] * rows.num_rows), rows.column("docs"), rows.column("times")], names=names(SUMS))
            batch = batch.filter(pc.invert(head))
            if not batch.num_rows:
                continue
            per = np.empty(batch.num_rows, np.int64)
            for i, word in enumerate(batch.column("word").to_pylist()):
                if word != last:
                    last, pieces = word, rules.pieces(word)
                per[i] = pieces
            ends, doc = flat(batch.column("docs"), "<u2")
            _, times = flat(batch.column("times"), np.uint8)
            n = np.diff(ends) // 2
            worth, blocks = np.repeat(per, n) * times, np.repeat(batch.column("block").to_numpy(), n)
            for number in np.unique(blocks):
                own = blocks == number
                sums = held.setdefault(number, np.zeros(BLOCK_DOCS, np.int64))
                np.add.at(sums, doc[own], worth[own])
            if len(held) > SUMS_HELD:
                yield from emit(held)
                held = {}
        yield from emit(held)

    def emit(held):
        for number, sums in held.items():
            doc = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([False]), pa.array([doc.astype("<u2").tobytes()]), pa.array([sums[doc].astype("<i8").tobytes()])], names=names(SUMS))

    def assemble(batches):
        at, own, sums = None, None, None
        for batch in batches:
            for new in batch.to_pylist():
                if new["own"]:
                    if own is not None:
                        yield table_of(own, sums)
                    at, own = new["block"], np.frombuffer(new["docs"], "<i8").reshape(4, -1)
                    sums = own[3].copy()
                elif new["block"] == at:
                    np.add.at(sums, np.frombuffer(new["docs"], "<u2"), np.frombuffer(new["sums"], "<i8"))
                else:
                    raise RuntimeError(f"sums of block {new['block']} without its documents")
        if own is not None:
            yield table_of(own, sums)

    def table_of(own, sums):
        columns = [pa.array(own[0], mask=own[1] == 1), pa.array(own[2]), pa.array(sums), pa.array(sums > limit)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    posted = rows.mapInArrow(postings, POSTINGS)
    deal = F.when(F.col("word") == "", F.xxhash64("block")).otherwise(F.xxhash64("word", F.expr(f"block div {SPAN << 24}")))
    dealt = posted.withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal", "word").drop("deal")
    sums = dealt.mapInArrow(count, SUMS).repartition("block").sortWithinPartitions("block", F.desc("own"))
    return sums.mapInArrow(assemble, "key long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and numbers of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return ends - ends[0], np.frombuffer(data.tobytes(), kind)
