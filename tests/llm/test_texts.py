"""License scan, token counts, pieces, toxicity, repeats, mixing and order against brute force, and awkward rows."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tabularium.llm import licenses, mixing, ordering, sentencepiece, suffix, token_counts, toxicity

LONG = "long text over and over. " * 4000
ODD = ["", None, " ", "  a  b\n\nc\t ", "it's We'LL 'S", "a\x1cb \x1f!", "<|endoftext|>x<|startoftext|> <|endoftext|>", "J̌a İ K", "日本語 ١٢", "á́ x y", "\U0001f600\U0001f44d 1234", "x" * 400, "'''s''re", "a\0b", "\r\n ();\r", LONG]
DOCS = "doc_id long, text string, _source string, spans_ string, n_chars long"


def odd(frame):
    return frame(DOCS, *[(i, t, "s", "c", 0) for i, t in enumerate(ODD)], (None, "plain words", None, None, None), (3, ODD[3], "s", "c", 0))


def texts():
    return [*enumerate(ODD), (None, "plain words"), (3, ODD[3])]


# licenses


def license_words(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def base_places(text):
    words, found = license_words(text), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        said = phrase.split()
        found += [(i, label) for i in range(len(words) - len(said) + 1) if words[i : i + len(said)] == said]
    return len(words), found


def test_base_phrases_are_found_wherever_they_stand(frame):
    rng = random.Random(1)
    words = ["cc", "BY", "general", "public", "license", "all", "rights", "reserved", "x", "K", "é"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 90))), "", "", 0) for i in range(60)]
    rows += [(100 + i, t, "", "", 0) for i, t in enumerate([None, "", "cc", "CC-BY", "all rights", "cc  by cc by", LONG + "CC by"])]
    got = licenses.scan_digest(licenses.license_spans(frame(DOCS, *rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        n, found = base_places(dict((a, b) for a, b, *_ in rows)[r.doc_id])
        starts = [i for i, _ in found]
        want = (n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want


def test_templates_with_changed_words(frame):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = notice.replace("hereby ", "").replace("any person", "any other person")
    half = " ".join(notice.split()[:8])
    rows = [(1, "x " + notice, "", "", 0), (2, "of the " * 50 + changed + " of the" * 50, "", "", 0), (3, half, "", "", 0), (3, half, "", "", 0), (None, "Released under the MIT License.", "", "", 0)]
    got = licenses.scan_digest(licenses.license_spans(frame(DOCS, *rows))).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == [("1", "mit"), ("2", "mit"), ("3", ""), ("3", ""), ("None", "mit")]
    assert licenses.license_spans(frame(DOCS, *rows).limit(0)).count() == 0


def test_license_scan_stays_in_the_engine(frame):
    plan = licenses.license_spans(odd(frame))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# token counts and pieces


def read(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def test_counts_are_those_of_the_library(frame, monkeypatch):
    from tokenizers import Tokenizer

    spec = read("word_bpe_49k.json").decode()
    library = Tokenizer.from_str(spec)
    got = token_counts.token_counts(odd(frame), spec, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in texts()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(odd(frame).limit(0), spec).count() == 0


def test_pieces_are_those_of_the_library(frame):
    import sentencepiece as library

    model = read("piece_bpe_32k.model")
    processor = library.SentencePieceProcessor(model_proto=model)
    rows = sentencepiece.encode(odd(frame), model)
    assert rows.columns == ["doc_id", "text", "_source", "spans_", "n_chars", "ids"]
    got = sentencepiece.decode(rows, model).collect()
    assert len(got) == len(texts())
    for r in got:
        assert r.ids == processor.encode(r.text or "")
        assert r.decoded == processor.decode(r.ids) == (r.text or "")
    lists = frame("ids array<int>", (None,), ([70000],), ([None],), ([],), ([3 + 0xC3],), ([1, 2],))
    assert [r.decoded for r in sentencepiece.decode(lists, model).collect()] == [None, None, None, "", "�", ""]
    with pytest.raises(ValueError):
        sentencepiece.encode(rows, model)


def hand_made(kind):
    """A vocabulary written by hand, as the library reads it."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    rng = random.Random(8)
    names = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    singles = [s for s in "abc▁"]
    longer = sorted({"".join(p) for n in (2, 3, 4) for p in itertools.product("abc", repeat=n) if rng.random() < 0.4} | {"▁a", "▁ab", "▁▁"})
    for i, name in enumerate(singles + longer):
        names.append((name, -rng.uniform(1, 9) if kind == 1 else -float(i), 1))
    for name, score, type_ in names:
        model.pieces.add(piece=name, score=score, type=type_)
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.remove_extra_whitespaces = False
    return model.SerializeToString()


@pytest.mark.parametrize("kind", [1, 2])
def test_folds_of_both_kinds_of_vocabulary(kind):
    import sentencepiece as library

    model = hand_made(kind)
    processor, pieces, rng = library.SentencePieceProcessor(model_proto=model), sentencepiece.Pieces.read(model), random.Random(2)
    for n in [*range(1, 40), 200]:
        line = "".join(rng.choice("aabbcc é") for _ in range(n))
        units = pieces.units(line)
        stretches = [s for u in units for s in pieces.parts(u)]
        got, want = pieces.fold(stretches)[0].tolist(), processor.encode(line)
        if kind == sentencepiece.BPE:
            assert got == want
        else:  # paths of equal score are told apart by rounding in the library
            assert abs(sum(pieces.scores[i] for i in got) - sum(pieces.scores[i] for i in want)) < 1e-3
            assert processor.decode(got) == processor.decode(want)


# toxicity


def labelled(n=400):
    rng = random.Random(6)
    words = ["ab" + "".join(rng.choices("cdefgh", k=4)) for _ in range(200)]
    docs, marks = [], []
    for i in range(n):
        said = rng.choices(words, k=rng.randrange(5, 80))
        if i % 4 == 0:
            for _ in range(3):
                said.insert(rng.randrange(len(said)), "vile" + "".join(rng.choices("mnop", k=2)))
        docs.append((i, " ".join(said), "", "", 0))
        marks.append((i, 1, int(i % 4 == 0)))
    return docs, marks


def test_toxic_texts_are_told_apart_on_the_held_out_fold(frame):
    docs, marks = labelled()
    docs += [(1000, "", "", "", 0), (1001, None, "", "", 0), (None, "you vilemm", "", "", 0), (5, docs[5][1], "", "", 0)]
    marks += [(5, 1, None), (None, 1, 1), (2000, 1, 1)]
    table, labels = frame(DOCS, *docs), frame("doc_id long, quality int, toxic int", *marks)
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        toxic = "vile" in (r.text or "")
        assert r.predicted == toxic, r
        assert all(e.cosine >= 0 for e in r.evidence)
    kept = toxicity.tolerable(table, labels)
    assert kept.columns == table.columns and kept.count() == sum("vile" not in (d[1] or "") for d in docs)


def test_labels_of_the_held_out_fold_are_not_learned(frame):
    docs, marks = labelled(200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(frame(DOCS, *docs), frame("doc_id long, quality int, toxic int", *m)).collect()) for m in (marks, turned)]
    assert scores[0] == scores[1]


def test_no_labels_and_no_documents(frame):
    docs, marks = labelled(20)
    labels = frame("doc_id long, quality int, toxic int", *marks)
    assert {r.score for r in toxicity.toxicity(frame(DOCS, *docs), labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(frame(DOCS, *docs).limit(0), labels).count() == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    examples = []
    for i in range(300):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        examples.append((i, int(rng.integers(2)), terms.tolist(), rng.integers(1, 4, len(terms)).tolist()))
    idf = rng.uniform(1, 5, 40)
    index = toxicity.Index.build(examples, idf, 0.1, 0.5, 16)
    dense = {}
    for key, _, terms, counts in examples:
        dense[key] = np.zeros(40)
        dense[key][terms] = toxicity.weights(np.array(terms), np.array(counts), idf)
    for _ in range(50):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        counts = rng.integers(1, 4, len(terms)).astype(float)
        at, cosine = index.nearest(terms, counts, 7)
        query = np.zeros(40)
        query[terms] = toxicity.weights(terms, counts, idf)
        want = np.sort([x for x in (v @ query for v in dense.values()) if x > 0])[::-1][:7]
        assert np.allclose(cosine, want)
        assert np.allclose(cosine, [dense[index.ids[i]] @ query for i in at])


# repeats


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for key, text in rows:
        line = (text or "").encode()
        gone = bytearray(len(line))
        for i in range(len(line) - length + 1):
            part = line[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(part)
        kept = bytes(c for c, g in zip(line, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(line), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(n=240):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh  é") for _ in range(3000))
    fill = lambda k: "".join(rng.choice("klmno") for _ in range(k))
    kinds = [
        lambda: base[rng.randrange(2000) :][: rng.randrange(50, 600)],
        lambda: "x" * rng.randrange(0, 700),
        lambda: "ab" * rng.randrange(0, 300),
        lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 300))),
        lambda: "",
        lambda: base[500:650] + fill(60) + base[900:1050],
        lambda: fill(40) + base[100:330] + fill(40),
        lambda: "\0" * rng.randrange(0, 300) + base[: rng.randrange(0, 200)],
    ]
    return [(i, kinds[i % 8]()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard": 7, "spread": 21}])
def test_repeats_are_those_of_brute_force(frame, sizes):
    rows = passages()
    got = suffix.digest(suffix.repeats(frame(DOCS, *[(i, t, "", "", 0) for i, t in rows]).repartition(3), **sizes))
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows)


def test_repeats_of_awkward_rows(frame):
    line = "a passage that is longer than one hundred bytes, so that it counts as repeated when it comes for a second time"
    rows = [(1, line, "", "", 9), (2, None, "", "", 0), (None, "é" + line + "é", "", "", 0), (2, "x " + line, "", "", 0), (4, "tail", "", "", 0), (4, "tail", "", "", 0)]
    left = suffix.stripped(frame(DOCS, *rows))
    assert left.columns == ["doc_id", "text", "_source", "spans_", "n_chars"]
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in left.collect()) == [("1", line, len(line)), ("2", "", 0), ("2", "x ", 2), ("4", "tail", 4), ("4", "tail", 4), ("None", "éé", 2)]
    assert suffix.repeats(frame(DOCS, *rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.repeats(frame("doc_id long, text string, kept string", (1, "a", "b")))


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 40, 30)
    text = rng.integers(0, 3, size.sum())
    first = np.cumsum(size) - size
    room = np.repeat(first + size, size) - np.arange(len(text))
    order, rank = suffix.suffix_array(text + 1, room)
    suffixes = [tuple(text[i : i + room[i]]) for i in range(len(text))]
    want = sorted(range(len(text)), key=lambda i: (suffixes[i], i))
    assert order.tolist() == want and (order[rank] == np.arange(len(text))).all()
    got = suffix.common_prefixes(text + 1, room, first, order, rank)
    for k in range(1, len(want)):
        a, b = suffixes[want[k - 1]], suffixes[want[k]]
        assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# mixing


def sources(frame):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        source = rng.choices(["big", "mid", "small", None, "blank"], [60, 20, 8, 4, 2])[0]
        rows.append((i, source, "w " * rng.randrange(1, 30) if source != "blank" else " ", "at", "block"))
    return rows, frame("doc_id long, source string, text string, at string, block string", *rows)


@pytest.mark.parametrize("target", [{"repeats": 3.0}, {"entropy": 1.2}, {"repeats": 1.0}, {"entropy": 9.0}])
def test_weights_meet_their_target(frame, target):
    rows, docs = sources(frame)
    got = mixing.mixture(docs, **target, blocks=16).select("doc.doc_id", "doc.source", "n_tokens", "weight", "epoch").collect()
    total = Counter()
    for _, s, t, *_ in rows:
        total[s] += len(t.split())
    weight = {r.source: r.weight for r in got}
    assert weight.pop("blank") == 0 and abs(sum(weight.values()) - 1) < 1e-9
    passes = [weight[s] / total[s] for s in weight]
    entropy = -sum(w * math.log(w) for w in weight.values())
    if target == {"repeats": 3.0}:
        assert abs(max(passes) / min(passes) - 3) < 1e-6
    elif target == {"repeats": 1.0}:
        assert max(passes) / min(passes) < 1 + 1e-9 and len(got) == len(rows)
    else:
        assert abs(entropy - min(target["entropy"], math.log(4))) < 1e-6
    # quotas are met to within one document, no document is lost, and a pass takes a document once
    taken, budget = Counter(), max(total[s] / weight[s] for s in weight)
    for r in got:
        taken[r.source] += r.n_tokens
    for s in weight:
        assert -1 <= weight[s] * budget - taken[s] <= 31  # a quota is a whole number
    assert {r.doc_id for r in got} == set(range(900))
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_a_small_budget_takes_part_of_every_source(frame):
    rows, docs = sources(frame)
    got = mixing.mixture(docs, repeats=2.0, budget=3000, blocks=512)
    tokens = got.groupBy("doc.source").agg(F.sum("n_tokens"), F.first("weight")).collect()
    for source, n, weight in tokens:
        assert -1 <= 3000 * weight - n <= 31 or source == "blank"
    line = got.orderBy("at", "turn").select("doc.source", "n_tokens").collect()
    half = Counter()
    for r in line[: len(line) // 2]:
        half[r.source] += r.n_tokens
    assert abs(half["big"] / sum(half.values()) - next(w for s, _, w in tokens if s == "big")) < 0.15


def test_mixing_keeps_columns_and_repeated_rows(frame):
    rows, docs = sources(frame)
    twice = docs.unionByName(docs)
    got = mixing.remixed(twice, repeats=1.0)
    assert got.columns == docs.columns and got.count() == 1800
    assert mixing.remixed(docs.limit(0), repeats=2.0).count() == 0
    empty = frame("doc_id long, source string, text string", (1, None, None), (2, "a", ""))
    assert mixing.remixed(empty, repeats=2.0).count() == 2
    with pytest.raises(ValueError):
        mixing.mixture(docs)


# training order


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_the_permutation_is_one(n):
    x = ordering.permuted(np.arange(n), n, 5)
    assert sorted(x) == list(range(n))
    assert (ordering.permuted(x, n, 5, backward=True) == np.arange(n)).all()
    assert n < 1000 or abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.1


def test_shards_hold_every_sequence_once(frame, spark, tmp_path):
    docs = odd(frame).repartition(3).cache()
    path = str(tmp_path / "shards")
    total = ordering.materialise(docs, path, length=64, per_shard=100)
    got = ordering.sequences(spark, path, 64, 100).collect()
    want = [(i, k // 64, line[k : k + 64]) for i, t in texts() for line in [(t or "").encode()] for k in range(0, len(line), 64)]
    assert total == len(want) == len(got)
    assert sorted(str((r.key, r.part, bytes(r.ids))) for r in got) == sorted(map(str, want))
    assert sorted(r.slot for r in got) == list(range(total)) and all(r.shard == r.slot // 100 for r in got)
    # one file a shard; a slot is found by arithmetic, and reading goes on from it
    one = next((tmp_path / "shards" / "shard=1").glob("part-*")).read_bytes()
    assert len(one) == 100 * ordering.record_size(64)
    at = next(r for r in got if r.slot == 142)
    record = one[42 * ordering.record_size(64) :][: ordering.record_size(64)]
    assert record[ordering.HEAD.itemsize :][: at.size] == bytes(at.ids) and record[-1:] == b"\n"
    assert sorted(r.slot for r in ordering.sequences(spark, path, 64, 100, first=150).collect()) == list(range(150, total))
    docs.unpersist()


def test_nothing_to_write(frame, tmp_path):
    empty = frame(DOCS, (1, "", "", "", 0), (2, None, "", "", 0))
    assert ordering.materialise(empty, str(tmp_path / "none")) == 0
    assert ordering.ordered(empty, str(tmp_path / "none")).count() == 0


# pipeline


def test_stages_keep_the_columns_and_take_effect(frame, spark, tmp_path):
    sys.path.insert(0, ".")
    import corpus_pipeline

    docs, marks = labelled(200)
    line = "a passage that is longer than one hundred bytes, so that it counts as repeated when it comes for a second time"
    rows = [(i, t, "en", "s" if i % 3 else "t", len(t)) for i, t, *_ in docs]
    rows += [(1000 + i, rows[1][1], "en", "s", 0) for i in range(5)] + [(2000 + i, f"{rows[2 + i][1]} {line}", "fr", "t", 0) for i in range(2)]
    folder = tmp_path / "sf"
    frame("doc_id long, text string, lang string, source string, n_chars long", *rows).write.parquet(str(folder / "documents.parquet"))
    frame("doc_id long, quality int, toxic int", *marks).write.parquet(str(folder / "labels.parquet"))
    now = spark.read.parquet(str(folder / "documents.parquet"))
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(folder))
        path = str(tmp_path / name.replace(" ", "-"))
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        assert name == "sentencepiece" or now.columns == columns
    clean = {r[0] for r in rows if "vile" not in r[1]}
    assert kept[0] == clean
    assert kept[1] <= clean and not kept[1] & set(range(1000, 1005)) and 1 in kept[1]
    assert kept[1] == kept[2] == kept[3] == kept[4]
    lines = spark.read.parquet(str(tmp_path / "repeated-passages")).where("doc_id >= 2000").orderBy("doc_id").collect()
    assert sum(line in r.text for r in lines) <= 1
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(folder)).select("doc_id").collect()} == kept[4]
