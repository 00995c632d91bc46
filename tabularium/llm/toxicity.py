"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Terms are words and their beginnings of four to six signs. Those that mark label 1 among the examples are the
vocabulary; document frequencies are counted over all documents. The postings of the examples are cut into
blocks of neighbouring examples, each with the largest weight of every term. A search takes blocks by their
upper bound and ends when no other block can hold a nearer example, so its neighbours are exact.
A score is the distance-weighted vote of the neighbours, drawn towards the share of label 1 by a fixed weight.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import no_clash, quoted, settled, whole_row

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 4, 6
MEMORY = 200_000  # words a task remembers the terms of
HELD_TERMS = 32_768  # candidates that a task looks up; more are joined


def terms_of(word: str) -> list[str]:
    """A word, marked as a whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


@dataclass
class Index:
    """Examples as unit vectors in blocks: postings by (term, block) and the largest weight in each."""

    ids: np.ndarray
    marks: np.ndarray
    idf: np.ndarray
    first: np.ndarray  # of the postings of (term, block)
    place: np.ndarray
    weight: np.ndarray
    most: np.ndarray  # terms x blocks
    none: float  # score of a text without any term
    rate: float
    block: int

    @classmethod
    def build(cls, examples: list[tuple], idf: np.ndarray, none: float, rate: float, block: int) -> Index:
        """Examples are (key, mark, terms, counts); similar ones are put next to each other."""
        rows = []
        for key, mark, terms, counts in examples:
            w = weights(np.array(terms), np.array(counts), idf)
            rows.append((int(terms[int(w.argmax())]), -float(w.max()), key, mark, np.array(terms), w))
        rows.sort(key=lambda r: r[:3])
        blocks = max(1, -(-len(rows) // block))
        term = np.concatenate([r[4] for r in rows]) if rows else np.empty(0, np.int64)
        at = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
        weight = np.concatenate([r[5] for r in rows]) if rows else np.empty(0)
        cell = term * blocks + at // block
        order = np.lexsort((at, cell))
        cell, at, weight = cell[order], at[order], weight[order]
        first = np.searchsorted(cell, np.arange(len(idf) * blocks + 1))
        most = np.zeros(len(idf) * blocks)
        np.maximum.at(most, cell, weight)
        return cls(np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], float), idf, first, at, weight, most.reshape(len(idf), blocks), none, rate, block)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest cosine and their cosines; of equal ones those that stand first."""
        w, blocks = weights(terms, counts, self.idf), self.most.shape[1]
        bound = w @ self.most[terms]
        found, cosine = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(found) == k and bound[b] < cosine[-1] - 1e-12):
                break
            score = np.zeros(self.block)
            for t, x in zip(terms, w):
                a, e = self.first[t * blocks + b], self.first[t * blocks + b + 1]
                score[self.place[a:e] - b * self.block] += x * self.weight[a:e]
            hit = np.flatnonzero(score > 0)
            found, cosine = np.r_[found, hit + b * self.block], np.r_[cosine, score[hit]]
            best = np.lexsort((found, -cosine))[:k]
            found, cosine = found[best], cosine[best]
        return found, np.minimum(cosine, 1.0)

    def score(self, terms: np.ndarray, counts: np.ndarray, k: int, soft: float, prior: float):
        """Score and neighbours of one vector."""
        if not len(terms) or not len(self.ids):
            return self.none, np.empty(0, np.int64), np.empty(0)
        at, cosine = self.nearest(terms, counts, k)
        if not len(at):
            return self.none, at, cosine
        vote = 1 / (1 - cosine + soft)
        return float((vote @ self.marks[at] + prior * self.rate) / (vote.sum() + prior)), at, cosine


def weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt(w @ w)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marking_terms(examples: DataFrame, least: float, share: float, most: int) -> list[str]:
    """Terms that mark label 1, ``most`` at most: by the examples that hold them, then by the places they stand at."""

    def count(batches):
        for batch in batches:
            seen, marked = Counter(), Counter()
            for line, mark in zip(batch.column("text"), batch.column("mark").to_pylist()):
                own = {t for w in {*WORD.findall((line.as_py() or "").lower())} for t in terms_of(w)}
                seen.update(own)
                if mark:
                    marked.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([marked[t] for t in seen], pa.int64())], names=["term", "n", "ones"])

    def places(batches):
        for batch in batches:
            found = set()
            for line, mark in zip(batch.column("text"), batch.column("mark").to_pylist()):
                words = ["", *WORD.findall((line.as_py() or "").lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    found.update((t, mark, f"{before} {after}") for t in terms_of(word) if candidates is None or t in candidates)
            columns = zip(*sorted(found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], names=["term", "mark", "place"])

    total, ones = examples.agg(F.count("*"), F.sum("mark")).first()
    if not total or not ones or ones == total:
        return []
    counts = examples.mapInArrow(count, "term string, n long, ones long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    first = settled(marked_by(counts, ones / total, least, share).select("term"), "terms")
    # few candidates are looked up in the tasks, many are joined: the same terms either way
    few = first.limit(HELD_TERMS + 1).collect()
    candidates = {r.term for r in few} if len(few) <= HELD_TERMS else None
    # copies of a text are one place; and a long text holds more of any word, so places are held against the share of words
    size = F.sum(F.octet_length("text"))
    marked, every = examples.agg(F.sum(F.when(F.col("mark") == 1, F.octet_length("text"))), size).first()
    seen = examples.mapInArrow(places, "term string, mark int, place string").distinct()
    seen = seen if candidates is not None else seen.join(first, "term", "left_semi")
    counts = seen.groupBy("term").agg(F.count("*").alias("n"), F.sum("mark").alias("ones"))
    chosen = marked_by(counts, (marked or 0) / max(1, every), least, share).orderBy(F.desc("g"), "term").limit(most)
    return [r.term for r in chosen.collect()]


def marked_by(counts: DataFrame, rate: float, least: float, share: float) -> DataFrame:
    """Terms of which label 1 has its ``share`` and more than ``rate``, with the G statistic of that: ``least`` or more."""
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    n, one = F.col("n"), F.col("ones")
    part = lambda seen, r: F.when(seen > 0, seen * F.log(seen / (n * F.lit(r)))).otherwise(0.0)
    g = (2 * (part(one, rate) + part(n - one, 1 - rate))).alias("g")
    return counts.where(one / n >= max(share, rate)).select("term", g).where(F.col("g") >= least)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    examples: int = 20_000,
    vocabulary: int = 4096,
    least: float = 18.0,
    share: float = 0.5,
    k: int = 15,
    block: int = 64,
    soft: float = 0.05,
    prior: float = 8.0,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    label_key: str | None = None,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (its columns, or ``keep``) with held_out, score, predicted and evidence (key, cosine, mark of all
    neighbours that vote, the nearest first).

    Fitted on at most ``examples`` labelled rows outside the held-out fold, those of the smallest hash of their key, and
    at most ``vocabulary`` terms; document frequencies and scores cover all rows. A missing or empty text has no
    term and the score of examples without one; so has every text if there is no label of both kinds (score 0 without
    any). Very long texts are read whole. Of equally near examples those that stand first in the index vote, by their terms and
    keys. A column of ``docs`` called like one of the new ones is an error. Keys labelled twice have their largest label; labels that are missing count for nothing; rows without a key
    are scored, and repeated rows each. An empty table gives no rows.
    """
    columns = list(keep or docs.columns)
    no_clash(docs.select(*[F.col(quoted(c)) for c in columns]), "held_out", "score", "predicted", "evidence")
    known = labels.select(F.col(quoted(label_key or key)).cast("long").alias("id"), F.col(quoted(label)).cast("int").alias("mark")).where("id IS NOT NULL AND mark IS NOT NULL AND mark IN (0, 1)")
    known = known.groupBy("id").agg(F.max("mark").alias("mark")).where(~held_out("id"))
    known = settled(known.orderBy(F.xxhash64("id"), "id").limit(examples), "examples")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("doc"), F.col(quoted(key)).cast("long").alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    sample = rows.select("id", "text").join(F.broadcast(known), "id")  # at most ``examples`` rows
    chosen = marking_terms(sample.select("text", "mark"), least, share, vocabulary)
    number = {t: i for i, t in enumerate(chosen)}

    def read(texts, memory: dict[str, tuple]):
        """Terms and their counts of each text; ``memory`` holds the terms of words seen before."""
        for line in texts:
            bag: Counter = Counter()
            for word, n in Counter(WORD.findall(line.as_py().lower())).items():
                terms = memory.get(word)
                if terms is None:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    terms = memory[word] = tuple(number[t] for t in terms_of(word) if t in number)
                for t in terms:
                    bag[t] += n
            order = sorted(bag)
            yield order, [bag[t] for t in order]

    def vector(batches):
        memory: dict[str, tuple] = {}
        for batch in batches:
            found = list(read(batch.column("text"), memory))
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "terms", "times"])

    vectors = settled(rows.select("id", "text").mapInArrow(vector, "id long, terms array<int>, times array<int>"), "vectors")
    total = vectors.count()
    seen = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per term of the vocabulary
    idf = np.array([np.log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in range(len(chosen))])
    fitted = vectors.select("id", "terms", "times").join(F.broadcast(known), "id").select("id", "mark", "terms", "times")
    bare, ones, every, marked = fitted.agg(F.count_if(F.size("terms") == 0), F.count_if((F.size("terms") == 0) & (F.col("mark") == 1)), F.count("*"), F.sum("mark")).first()
    rate = (marked or 0) / every if every else 0.0
    none = (ones + rate) / (bare + 1) if every else 0.0
    taken = [tuple(r) for r in fitted.where(F.size("terms") > 0).dropDuplicates(["id"]).collect()]  # at most ``examples`` rows
    index = docs.sparkSession.sparkContext.broadcast(Index.build(taken, idf, none, rate, block))

    def score(batches):
        this, cache, memory = index.value, {}, {}
        for batch in batches:
            scores, places, cosines = [], [np.empty(0, np.int64)], [np.empty(0)]
            for terms, times in read(batch.column("text"), memory):
                name = (*terms, -1, *times)
                if name not in cache:
                    if len(cache) >= MEMORY // 10:
                        cache.clear()
                    cache[name] = this.score(np.array(terms, np.int64), np.array(times, float), k, soft, prior)
                value, at, cosine = cache[name]
                scores.append(value)
                places.append(at)
                cosines.append(cosine)
            at, ends = np.concatenate(places), np.cumsum([len(p) for p in places])  # the first of them is empty
            near = [pa.array(this.ids[at], pa.int64()), pa.array(np.concatenate(cosines), pa.float64()), pa.array(this.marks[at].astype(np.int32), pa.int32())]
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(near, names=["doc_id", "cosine", "mark"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("id"), pa.array(scores, pa.float64()), evidence], names=["doc", "id", "score", "evidence"])

    # texts are read a second time: a stored copy of them would cost more than their words
    near = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("mark", T.IntegerType())])
    schema = [rows.schema["doc"], T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(near))]
    scored = rows.mapInArrow(score, T.StructType(schema))
    out = scored.select("doc", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in columns], "held_out", "score", "predicted", "evidence")


def tolerable(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with their columns."""
    key, text = settings.pop("key", "doc_id"), settings.pop("text", "text")
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    scored = toxicity(rows, labels, keep=("row",), key="key", text="text", label_key=settings.pop("label_key", key), **settings)
    return scored.where("predicted = 0").select("row.*")
