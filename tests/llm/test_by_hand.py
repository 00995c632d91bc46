"""Toxicity, mixing and all stages of the pipeline against their plain versions, row by row."""

import os
import random
import sys
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece as library
from pyspark.sql import functions as F
from tabularium.llm import mixing, ordering, suffix, toxicity

sys.path.insert(0, os.path.dirname(__file__))
import by_hand  # noqa: E402
import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=6):
    """Documents with toxic words, near copies, shared passages and uneven sources, and labels of some."""
    rng = random.Random(seed)
    words = ["ab" + "".join(rng.choices("cdefghé", k=4)) for _ in range(150)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    rows, labels = [], []
    for i in range(n):
        said = rng.choices(words, k=rng.randrange(8, 60))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            said.insert(rng.randrange(len(said)), "vile" + "".join(rng.choices("mnop", k=2)))
        if i % 6 == 1:
            said.insert(rng.randrange(len(said)), rng.choice(passages))
        text = " ".join(said)
        rows.append((i, text, "en", rng.choices(["big", "mid", "small", None], [70, 20, 7, 3])[0], len(text)))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    for i in range(12):  # copies, some with a word changed
        text = rows[1 + 4 * i][1] + (" end" if i % 3 == 0 else "")
        rows.append((n + i, text, "fr", "copy", len(text)))
    rows += [(n + 50, "", "en", "blank", 0), (n + 51, "one", "en", "mid", 3)]
    return rows, labels


def neighbours(evidence):
    return sorted((round(c, 9), m) for _, c, m in evidence)


def test_toxicity_equals_comparing_with_all_examples(frame):
    rows, labels = corpus()
    rows += [(900, None, None, None, None), (None, "you vilemn and vileop", None, None, None), (3, rows[3][1], "x", "y", 1)]
    labels += [(7, 1, None), (8, 0, 0), (8, 0, 1), (None, 1, 1), (5000, 1, 1), (9, 1, 7)]
    got = toxicity.toxicity(frame(DOCS, *rows).repartition(3), frame("doc_id long, quality int, toxic int", *labels)).collect()
    want = by_hand.toxicity([r[:2] for r in rows], [(k, m) for k, _, m in labels])
    assert len(got) == len(want)
    found = sorted(((str(r.doc_id), round(r.score, 9), neighbours(map(tuple, r.evidence))) for r in got), key=repr)
    assert found == sorted(((str(k), round(s, 9), neighbours(e)) for k, s, e in want), key=repr)


@pytest.mark.parametrize("held", [1, 100_000])
def test_terms_are_the_same_looked_up_or_joined(frame, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD_TERMS", held)
    rows, labels = corpus(80)
    known = {k: m for k, _, m in labels if not by_hand.held_out(k)}
    examples = frame("text string, mark int", *[(t, known[k]) for k, t, *_ in rows if k in known])
    terms = toxicity.marking_terms(examples, 5.0, 0.5, 4096)
    monkeypatch.setattr(toxicity, "HELD_TERMS", 50)
    assert terms and terms == toxicity.marking_terms(examples, 5.0, 0.5, 4096)


def orders(spark, seed=17):
    """The keyed orders, as Spark's own hash gives them."""
    memory = {}

    def hashed(*columns):
        name = repr(columns)
        if name not in memory:
            row = spark.range(1).select(F.xxhash64(*[F.lit(c).cast(t) for c, t in columns])).first()
            memory[name] = row[0]
        return memory[name]

    return (
        lambda source, epoch, block: hashed((seed, "int"), (source, "string"), (epoch, "long"), (block, "long")),
        lambda epoch, h: hashed((seed + 1, "int"), (epoch, "long"), (h, "long")),
    )


def hashes(spark, rows, seed=17):
    df = spark.createDataFrame([(i, k, t) for i, (k, _, t) in enumerate(rows)], "i long, k long, t string")
    return [r[1] for r in sorted(df.select("i", F.xxhash64(F.lit(seed), F.col("k").cast("string"), "t")).collect())]


@pytest.mark.parametrize("evenness", [0.0, 0.3, 0.9, 1.0])
def test_mixing_takes_every_row_as_often_as_by_hand(frame, spark, evenness):
    rows = [(k, s, t) for k, t, _, s, _ in corpus(70)[0]]
    rows += [(None, "big", "a b c"), (2000, None, None), rows[5], rows[5]]
    got = mixing.mixture(frame("doc_id long, source string, text string", *rows), evenness=evenness)
    counted = Counter((r.doc_id, r.source, r.text) for r in got.select("doc.*").collect())
    want = Counter()
    for row, n in zip(rows, by_hand.passes(rows, evenness, hashes(spark, rows), *orders(spark))):
        want[row] += n
    assert counted == want
    weights = {r._source: r.weight for r in got.select(F.coalesce("doc.source", F.lit("")).alias("_source"), "weight").distinct().collect() if r.weight}
    assert abs(sum(weights.values()) - 1) < 1e-9 and (evenness < 1 or max(weights.values()) - min(weights.values()) < 1e-6)


def test_a_target_between_the_ends_is_bisected(frame):
    shares = frame("p double", (0.7,), (0.2,), (0.1,))
    power = mixing.exponent(shares, None, None, 0.5)
    (_, own, _), (_, even, _), (_, got, _) = mixing.mixed_by(shares, [1.0, 0.0, power])
    assert 0 < power < 1 and abs(got - (own + even) / 2) < 1e-9
    with pytest.raises(ValueError, match="one target"):
        mixing.exponent(shares, 1.0, None, 0.5)


def test_repeated_passages_by_hash_and_byte_by_byte(frame):
    rows, _ = corpus(120)
    docs = frame(DOCS, *rows).repartition(4)
    ways = [sorted(map(repr, suffix.digest(suffix.repeats(docs, by_hash=by_hash, spread=spread, shard=64)).collect())) for by_hash in (True, False) for spread in (8, 4096)]
    assert ways[0] == ways[1] == ways[2] == ways[3]


def test_every_stage_equals_its_plain_version(frame, spark, tmp_path):
    rows, labels = corpus()
    frame(DOCS, *rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    frame("doc_id long, quality int, toxic int", *labels).write.parquet(f"{tmp_path}/labels.parquet")
    want = {r[0]: r for r in rows}
    toxic = {k for k, s, _ in by_hand.toxicity([r[:2] for r in rows], [(k, m) for k, _, m in labels]) if s >= 0.5}
    plain = [[r for r in rows if r[0] not in toxic]]
    plain.append(by_hand.without_near_copies(plain[0]))
    plain.append([(*r[:4], len(r[1])) for r in by_hand.without_repeats(plain[1])])
    short = [(k, s, t) for k, t, _, s, _ in plain[2]]
    many = by_hand.passes(short, 0.5, hashes(spark, short), *orders(spark))
    plain.append([r for r, n in zip(plain[2], many) for _ in range(n)])
    assert toxic and len(plain[1]) < len(plain[0]) and sum(len(r[1]) for r in plain[2]) < sum(len(r[1]) for r in plain[1]) and len(plain[3]) > len(plain[2])
    assert len({s for s, n in zip((r[3] for r in plain[2]), many) if n > 1}) >= 1 and len(want) == len(rows)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows_ in zip(corpus_pipeline.STAGES, plain):
        stage(spark, docs, str(tmp_path)).write.parquet(path := f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
        got = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        assert Counter(got) == Counter(rows_), name
    processor = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = Counter((r[0], r[2], r[3], tuple(processor.encode(r[1]))) for r in plain[3])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "ids"]
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in out.collect()) == ids


def test_ids_of_a_vocabulary_are_written_and_read_back(frame, spark, tmp_path):
    rng = random.Random(4)
    lists = {i: [rng.randrange(70_000) for _ in range(rng.randrange(0, 900))] for i in range(40)}
    docs = frame("doc_id long, `i.d` string, ids array<int>", *[(k, "x", v) for k, v in lists.items()], (50, "x", None), (51, "y", []))
    packed = ordering.packed_ids(docs, width=4)
    assert packed.columns == docs.columns
    total = ordering.materialise(packed, f"{tmp_path}/shards", length=1024, per_shard=7, text="ids")
    read = ordering.sequences(spark, f"{tmp_path}/shards", length=1024, per_shard=7).collect()
    assert len(read) == total == sum(-(-len(v) // 256) for v in lists.values())
    import numpy as np

    back = {}
    for r in sorted(read, key=lambda r: (r.key, r.part)):
        back.setdefault(r.key, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert back == {k: v for k, v in lists.items() if v}
    with pytest.raises(Exception, match="2 bytes"):
        ordering.packed_ids(docs, width=2).collect()
    with pytest.raises(Exception, match="4 bytes"):
        ordering.packed_ids(frame("ids array<int>", ([1, None],)), width=4).collect()
