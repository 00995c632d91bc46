"""Ranked lexical search over bit-sliced Bloom signatures.

Index: tasks turn blocks of documents with about as many different terms into one Bloom signature per document,
stored by slices: a row per signature bit, with one bit per document. A term that occurs two, three, four, six, eight
times ... is entered again at every such level, so that the AND of a term's rows at a level tells which documents may
hold it that often; none that does is missed. Lengths and exact document frequencies are stored beside.

Search: the weight of a term times the most that a document of that length can gain at the highest level it may have,
summed over the terms of an item, is an upper bound of the score. The documents with the highest bounds are scored
from their texts; the last of the best exact scores is a floor, and all documents whose bound isn't below it are
scored as well. What is left out provably has a lower score than those found.

Items are taken in batches of bounded size, each against the whole index. Documents meet their items by a join on
their key; Spark broadcasts the candidates only where their stored size allows it.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .numbers import Numbers
from .storage import quoted, settled

#: What stands between terms becomes a space, and A-Z become small; all other bytes belong to terms.
SIGNS = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS_AT_ONCE, DOCS_AT_ONCE, CELLS = 2 << 20, 1 << 13, 1 << 24
#: A batch of items: their terms take so many bytes, and an item at least the second number of them.
ITEM_BYTES, LEAST_BYTES = 1 << 19, 512
BITS_PER_ENTRY, HASHES = 20, 5
#: A term is entered once for each of these numbers of occurrences that it reaches.
OFTEN = np.array([1, 2, 3, *[n << i for i in range(40) for n in (4, 6)]])
LEVEL, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KINDS = {"n_docs": T.IntegerType(), "n_rows": T.LongType(), "top": T.IntegerType(), "ids": T.BinaryType(), "sizes": T.BinaryType()}
KINDS |= {"bits": T.BinaryType(), "term": T.BinaryType(), "df": T.LongType()}
INDEX = T.StructType([T.StructField(name, kind) for name, kind in KINDS.items()])


def terms(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


def mixed(words: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each hashed term at a level; the second is odd."""
    h = words + np.uint64(int(LEVEL) * level % 2**64)
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    h = (h ^ (h >> np.uint64(29))) * LEVEL
    h ^= h >> np.uint64(32)
    return h, (h * FACTOR) | np.uint64(1)


def slices(words: np.ndarray, level: int, n_rows: int) -> np.ndarray:
    """The signature rows of each hashed term at a level, one line per hash."""
    first, step = mixed(words, level)
    return np.stack([(first + np.uint64(i) * step) % np.uint64(n_rows) for i in range(HASHES)]).astype(np.int64)


def hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Signature blocks, document frequencies and sizes of all documents, as a stored table.

    Three kinds of rows: blocks (``bits`` has ``n_rows`` slices over the ``n_docs`` documents whose keys and lengths
    are in ``ids`` and ``sizes``; ``top`` is their highest level), terms (``df`` documents of one stretch of the table
    hold ``term``), and one row per stretch with its documents that have a term (``n_docs``) and all their terms
    (``df``). Documents without a key count for frequencies and sizes, but are in no block.
    """

    def work(batches):
        numbers, ids, sizes, which, times, held = Numbers(), [], [], [], [], 0
        for batch in batches:
            for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(raw.as_py() or b"")
                if words:
                    bag = Counter(words)
                    ids.append(id_)
                    sizes.append(len(words))
                    which.append(np.fromiter(map(numbers.__getitem__, bag), np.int32, len(bag)))
                    times.append(np.fromiter(bag.values(), np.int32, len(bag)))
                    held += len(words)
                if held >= WORDS_AT_ONCE or len(ids) == DOCS_AT_ONCE:
                    yield from stretch([*numbers], ids, np.array(sizes), which, times)
                    numbers, ids, sizes, which, times, held = Numbers(), [], [], [], [], 0
        if ids:
            yield from stretch([*numbers], ids, np.array(sizes), which, times)

    def stretch(names, ids, sizes, which, times):
        doc = np.repeat(np.arange(len(ids)), [len(w) for w in which])
        which = np.concatenate(which)
        df = np.bincount(which)
        for a in range(0, len(names), 8192):
            some = names[a : a + 8192]
            yield rows(len(some), term=some, df=df[a : a + 8192])
        yield rows(1, n_docs=[len(ids)], df=[int(sizes.sum())])
        words, levels = hashed(names), np.searchsorted(OFTEN, np.concatenate(times), side="right") - 1
        # documents with about as many entries share a width: steps by the root of two
        step = np.ceil(2 * np.log2(np.bincount(doc, weights=levels + 1))).astype(np.int64)
        step[[i for i, id_ in enumerate(ids) if id_ is None]] = -1
        for s in np.unique(step[step >= 0]):
            n_rows = math.ceil(BITS_PER_ENTRY * 2 ** (s / 2))
            own, at_once = np.flatnonzero(step == s), max(8, CELLS // n_rows)
            for a in range(0, len(own), at_once):
                some = own[a : a + at_once]
                place = np.full(len(ids), -1)
                place[some] = np.arange(len(some))
                mine = np.flatnonzero(place[doc] >= 0)
                top = int(levels[mine].max())
                cells = np.zeros((n_rows, len(some)), bool)
                for level in range(top + 1):
                    mine = mine[levels[mine] >= level]
                    cells[slices(words[which[mine]], level, n_rows), place[doc[mine]]] = True
                bits = np.packbits(cells, axis=1, bitorder="little").tobytes()
                own_ids = np.array([ids[i] for i in some], "<i8").tobytes()
                yield rows(1, n_docs=[len(some)], n_rows=[n_rows], top=[top], ids=[own_ids], sizes=[sizes[some].astype("<i8").tobytes()], bits=[bits])

    kinds = to_arrow_schema(INDEX)

    def rows(n, **given):
        return pa.RecordBatch.from_arrays([pa.array(given.get(f.name, [None] * n), f.type) for f in kinds], schema=kinds)

    return settled(keyed(docs, key, text).mapInArrow(work, INDEX), "signatures")


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text as bytes) of a table, whatever else its columns are called."""
    return df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).cast("string").cast("binary").alias("text"))


class Asked:
    """A batch of items: their terms, what these weigh, and the sizes of the corpus."""

    def __init__(self, pairs: list[tuple[int, bytes]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        # a term of no document adds nothing to any score
        self.weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        numbers, items = Numbers(), {}
        for item, term in pairs:
            if self.weight.get(term):
                items.setdefault(item, []).append(numbers[term])
        self.items, self.terms, self.number = [*items], [*numbers], dict(numbers)
        self.of = [np.sort(np.array(own)) for own in items.values()]
        self.weights = np.array([self.weight[t] for t in self.terms], np.int64)
        self.hashes = hashed(self.terms)

    def gain(self, tf: int, n: int) -> int:
        """What a unit of weight gains in a document of ``n`` terms from ``tf`` occurrences."""
        return 1_000_000_000 * tf // (1000 * tf + 8 * self.length(n))

    def length(self, n: int) -> int:
        return 10 + 90 * n * self.n_docs // self.n_terms

    def scores(self, words: list[bytes], items: list[int]) -> np.ndarray:
        """Exact scores of some items in a text."""
        often, n = Counter(map(self.number.get, words)), len(words)
        often.pop(None, None)
        worth = np.zeros(len(self.terms), np.int64)
        held, tf = np.array([*often], np.int64), np.array([*often.values()], np.int64)
        worth[held] = self.weights[held] * (1_000_000_000 * tf // (1000 * tf + 8 * self.length(n)))
        return np.add.reduceat(worth[np.concatenate([self.of[i] for i in items])], np.cumsum([0, *[len(self.of[i]) for i in items[:-1]]]))

    def bounds(self, block: dict) -> np.ndarray:
        """No score of an item (row) in a document of the block (column) is above these."""
        n_docs, n_rows = block["n_docs"], block["n_rows"]
        bits = np.frombuffer(block["bits"], np.uint8).reshape(n_rows, -1)
        sizes, of = np.unique(np.frombuffer(block["sizes"], "<i8"), return_inverse=True)
        out, may = np.zeros((len(self.items), n_docs), np.int64), {}
        before, at_once = np.zeros(len(sizes), np.int64), max(64, CELLS // n_docs)
        for level in range(block["top"] + 1):
            most = np.array([self.gain(min(int(OFTEN[level + 1]) - 1, n), n) for n in sizes.tolist()])
            more, before = (most - before)[of], most
            for a in range(0, len(self.terms), at_once):
                lines = slices(self.hashes[a : a + at_once], level, n_rows)
                there = reduce(np.bitwise_and, (bits[line] for line in lines))
                if level:  # who holds a term three times holds it twice
                    there &= may[a]
                may[a] = there
                some = np.flatnonzero(there.any(axis=1))
                if not len(some):
                    continue
                flags = np.unpackbits(there[some], axis=1, count=n_docs, bitorder="little")
                at = np.full(len(there), -1)
                at[some] = np.arange(len(some))
                for i, own in enumerate(self.of):
                    mine = own[np.searchsorted(own, a) : np.searchsorted(own, a + at_once)]
                    if len(mine := mine[at[mine - a] >= 0]):
                        out[i] += more * (self.weights[mine] @ flags[at[mine - a]])
        return out


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    probe: int = 32,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` documents of the highest score above 0 for every item: item_key, rank (from 1), key, score.

    Terms are runs of ASCII letters and digits and of all other signs beyond ASCII, with A-Z lower-cased; the score is
    integer arithmetic throughout (see ``Asked``). Equal scores rank by ascending key. A missing or empty text
    has no terms: such a document counts nowhere, such an item has no rows. Documents without a key count in the
    statistics and are not returned, items without a key are left out; rows that share an item's key are one item with the
    terms of all, rows that share a document's key are ranked each. Very long texts are taken whole. An empty table
    on either side gives no rows. Other columns are not read. ``probe`` documents per item are scored for the floor.
    """
    spark, kept = docs.sparkSession, T.StructType([T.StructField(n, T.LongType()) for n in ("item", "doc", "score")])
    stored = index(docs, key, text)
    n_docs, n_terms = stored.where("term IS NULL AND bits IS NULL").agg(F.sum("n_docs"), F.sum("df")).first()
    asked = settled(keyed(items, item_key, item_text).where("key IS NOT NULL").mapInArrow(item_terms, "item long, term binary").distinct(), "items")
    sizes = asked.groupBy("item").agg((F.sum(F.octet_length("term") + 16) + LEAST_BYTES).alias("size"))
    size = sizes.agg(F.sum("size")).first()[0] or 0
    batches = -(-size // ITEM_BYTES) if n_docs else 0
    found = [scored(docs, stored, batch, n_docs, n_terms, k, probe, key, text, kept) for batch in parts(asked, batches)]
    found = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kept)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")


def item_terms(batches):
    for batch in batches:
        for item, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = [*{*terms(raw.as_py() or b"")}]
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item", "term"])


def parts(asked: DataFrame, batches: int):
    """Batches of items of about ``ITEM_BYTES`` each (an item is never split)."""
    for b in range(batches):
        yield asked.where(F.pmod(F.xxhash64("item"), F.lit(batches).cast("long")) == b)


def scored(docs, stored, batch, n_docs, n_terms, k, probe, key, text, kept) -> DataFrame:
    """Exact scores of all documents that can be among the best ``k`` of the items of one batch."""
    # a batch has a bounded size, and so have its terms
    used = stored.where("term IS NOT NULL").join(F.broadcast(batch.select("term").distinct()), "term")
    df = {bytes(t): n for t, n in used.groupBy("term").agg(F.sum("df")).collect()}
    ask = Asked(sorted((r.item, bytes(r.term)) for r in batch.collect()), df, n_docs, n_terms)
    blocks = stored.where("bits IS NOT NULL").select("n_docs", "n_rows", "top", "ids", "sizes", "bits")
    pairs = "item int, doc long, bound long"

    def every(batches):
        for some in batches:
            for i in range(some.num_rows):
                block = some.slice(i, 1).to_pylist()[0]
                yield np.frombuffer(block["ids"], "<i8"), ask.bounds(block)

    def highest(batches):
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ask.items)
        for ids, bounds in every(batches):
            for item, bound in enumerate(bounds):
                own, old = best[item]
                some = np.flatnonzero(bound > (old.min() if len(old) == probe else 0))
                if len(some):
                    own, old = np.concatenate([own, ids[some]]), np.concatenate([old, bound[some]])
                    top = np.argsort(-old, kind="stable")[:probe]
                    best[item] = own[top], old[top]
        for item, (own, old) in enumerate(best):
            yield table_of(np.full(len(own), item), own, old)

    def table_of(item, doc, bound):
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(bound, pa.int64())], names=["item", "doc", "bound"])

    def exact(least):
        def run(batches):
            for some in batches:
                out = []
                for doc, raw, items in zip(some.column("key").to_pylist(), some.column("text"), some.column("items").to_pylist()):
                    for item, score in zip(items, ask.scores(terms(raw.as_py() or b""), items).tolist()):
                        if score >= least[item]:
                            out.append((ask.items[item], doc, score))
                columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))]
                yield pa.RecordBatch.from_arrays(columns, names=kept.names)

        return run

    def rescored(candidates, least):
        wanted = settled(candidates.groupBy("doc").agg(F.collect_set("item").alias("items")), "candidates")
        texts = keyed(docs, key, text).join(wanted, F.col("key") == F.col("doc"))
        return settled(texts.select("key", "text", "items").mapInArrow(exact(least), kept), "scores")

    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "doc")
    first = blocks.mapInArrow(highest, pairs).withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= probe)
    first = settled(first.select("item", "doc"), "probes")
    known = rescored(first, [1] * len(ask.items))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    floors = known.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k)
    floor = {r.item: r.score for r in floors.collect()}
    least = np.array([floor.get(item, 1) for item in ask.items], np.int64)

    def possible(batches):
        for ids, bounds in every(batches):
            item, doc = np.nonzero(bounds >= least[:, None])
            yield table_of(item, ids[doc], bounds[item, doc])

    rest = blocks.mapInArrow(possible, pairs).join(first, ["item", "doc"], "left_anti")
    return known.unionByName(rescored(rest, least))


def search_sql(k: int = 10) -> str:
    """The same ranking as SQL over the tables documents and benchmark."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH said AS (SELECT doc_id, unnest({words}) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
long AS (SELECT doc_id, sum(tf)::HUGEINT AS n FROM held GROUP BY ALL),
corpus AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS total FROM long),
term AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM corpus) + 2)::DOUBLE / (2 * count(*) + 1)))::HUGEINT AS w FROM held GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
score AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN term USING (term) JOIN long USING (doc_id), corpus GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
