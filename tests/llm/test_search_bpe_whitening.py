"""Ranked search, BPE and whitening against brute force and the public library, and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tabularium.llm import bitsliced, bpe, whitening
from tabularium.llm.queries import vocabulary
from tokenizers import Tokenizer

# ranked search


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def best(docs, items, k=10):
    """Every document scored for every item, by the formula as it stands."""
    bags = [(key, Counter(words(t))) for key, t in docs]
    bags = [(key, bag, sum(bag.values())) for key, bag in bags if bag]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, said in items.items():
        scores = []
        for key, bag, n in bags:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in said if t in bag)
            if score and key is not None:
                scores.append((-score, key))
        out += [(item, i + 1, key, -score) for i, (score, key) in enumerate(sorted(scores)[:k])]
    return out


def asked(rows):
    items = {}
    for key, text in rows:
        if key is not None:
            items.setdefault(key, set()).update(words(text))
    return items


def test_search_equals_scoring_every_document(frame, monkeypatch):
    monkeypatch.setattr(bitsliced, "DOCS_AT_ONCE", 64)  # several stretches and many blocks
    monkeypatch.setattr(bitsliced, "CELLS", 4096)  # and many terms in several steps
    rng = random.Random(3)
    vocabulary_ = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 5))) for _ in range(300)]
    often = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary_, often, k=int(2 ** rng.uniform(0, 9))))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(90)]  # equal scores
    docs += [(None, "abc ab"), (5, "a b c"), (5, "a b c"), (900, None), (901, ""), (902, "-- !"), (903, "A-b K É_x ab" * 9000)]
    items = [(i, " ".join(rng.choices(vocabulary_, k=rng.randrange(1, 40)))) for i in range(25)]
    items += [(25, docs[7][1]), (26, None), (27, "zzzz unknown"), (None, "ab"), (28, "ab"), (28, "ba ab"), (29, "K É")]
    extra = "long, text string, bits string, term string"
    got = bitsliced.search(frame("doc_id " + extra, *[(*d, "x", "y") for d in docs]), frame("item_id " + extra, *[(*i, "x", "y") for i in items]), probe=10)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(best(docs, asked(items)))


def test_search_in_several_batches_of_items(frame, monkeypatch):
    monkeypatch.setattr(bitsliced, "ITEM_BYTES", 1200)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 9, 12))) for i in range(60)]
    items = [(i, f"w{i} w{i + 3} w11") for i in range(12)]
    got = bitsliced.search(frame("doc_id long, text string", *docs), frame("item_id long, text string", *items))
    assert sorted(map(tuple, got.collect())) == sorted(best(docs, asked(items)))


def test_bounds_are_never_below_scores(frame):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghij", [2**i for i in range(10)], k=rng.randrange(1, 300))) for _ in range(50)]
    stored = bitsliced.index(frame("doc_id long, text string", *enumerate(texts)).coalesce(1))
    df = Counter(t.encode() for text in texts for t in set(text.split()))
    ask = bitsliced.Asked([(i, bytes([97 + (i + j) % 10])) for i in range(10) for j in range(3)], df, 50, sum(len(t.split()) for t in texts))
    seen = 0
    for block in stored.where("bits IS NOT NULL").collect():
        bounds = ask.bounds(block.asDict())
        for doc, bound in zip(np.frombuffer(block.ids, "<i8"), bounds.T):
            exact = ask.scores(bitsliced.terms(texts[doc].encode()), list(range(len(ask.items))))
            assert (exact <= bound).all()
            seen += 1
    assert seen == 50


def test_search_of_empty_tables(frame):
    docs, items = frame("doc_id long, text string", (1, "a b")), frame("item_id long, text string", (1, "a"))
    assert bitsliced.search(docs.limit(0), items).count() == 0
    assert bitsliced.search(docs, items.limit(0)).count() == 0
    assert bitsliced.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


# BPE

SPEC = public_tokenizers.path("word_bpe_49k.json")
LONG = "long text over and over. " * 4000
ODD = ["", None, " ", "  a  b\n\nc\t ", "it's We'LL 'S", "a\x1cb \x1f!", "<|endoftext|>x<|startoftext|> <|endoftext|>", "J̌a İ K ΑΣ ΑΣ.", "日本語 ١٢", "á́ x y", "\U0001f600\U0001f44d 1234", "x" * 400, "'''s''re", "a\0b", "\r\n ();\r", LONG, "<|endoftext", "|>"]


def spec():
    return vocabulary("word_bpe_49k.json").decode()


def test_ids_and_texts_are_those_of_the_library(frame, spark):
    library = Tokenizer.from_file(SPEC)
    rows = [*enumerate(ODD), (None, "plain words"), (3, ODD[3])]
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows += [(1000 + r.doc_id, r.text) for r in own]
    docs = frame("doc_id long, text string, ids string, key string, decoded long", *[(*r, "i", "k", 0) for r in rows])
    got = bpe.digest(bpe.encode(docs, spec(), decoded=True)).collect()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((key, len(ids), *digests))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_decode_gives_what_the_library_gives(frame):
    library = Tokenizer.from_file(SPEC)
    rows = [(1, [320, 49407, 5]), (2, []), (3, None), (4, [10**6, 7, -3, None, 9]), (None, [8])]
    got = dict(map(tuple, bpe.decode(frame("`a.b` long, ids array<int>", *rows), spec(), key="a.b").collect()))
    assert got == {key: library.decode([i for i in ids or [] if i is not None and i >= 0], skip_special_tokens=False) for key, ids in rows}
    assert bpe.encode(frame("doc_id string, text string", ("x", "a")).limit(0), spec()).count() == 0


def test_rows_of_trees_and_the_single_tree_merge_alike(monkeypatch):
    rng = random.Random(9)
    tokens = ["".join(rng.choices("abcehinorst", k=rng.randrange(2, 60))) for _ in range(300)] + ["the", "ab", "in"]
    library, encoder = Tokenizer.from_file(SPEC), bpe.Encoder(spec())
    want = [[t.id for t in library.model.tokenize(token)] for token in tokens]
    together, ends = encoder.merged(tokens)
    assert [together[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    monkeypatch.setattr(bpe, "LONGEST_ROW", 1)
    single, ends = encoder.merged(tokens)
    assert [single[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_a_full_table_of_words_is_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    encoder, library = bpe.Encoder(spec()), Tokenizer.from_file(SPEC)
    for text in ("one two three four five six", "two seven <|endoftext|> six", "one"):
        assert encoder.encoded([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_vocabularies_with_other_rules_are_refused():
    for old, new in (('"unk_token": null', '"unk_token": "a"'), ('"byte_fallback": false', '"byte_fallback": true'), ('"decoder": null', '"decoder": {"type": "ByteLevel"}'), ('"content": " "', '"content": "_"')):
        text = spec()
        changed = text.replace(old, new, 1) if old in text else text.replace(old.replace(": ", ":"), new.replace(": ", ":"), 1)
        assert changed != text
        with pytest.raises(ValueError, match="vocabular"):
            bpe.Encoder(changed)


# whitening


def by_hand(vectors, most=16):
    """Whitened values of the sound vectors by numpy over the distinct ones; rows (key, whole vector)."""
    good = [(k, [math.floor(64 * float(c)) + 1000000 for c in v]) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    off = fit - total / n
    variance, axes = np.linalg.eigh(off.T @ off / n)
    variance, axes = variance[::-1][:most], axes[:, ::-1][:, :most]
    return good, n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ axes / np.sqrt(variance), variance / np.trace(off.T @ off / n)


def test_whitening_equals_numpy(frame):
    rng = np.random.default_rng(4)
    made = rng.normal(size=(700, 20)) * np.linspace(0.2, 3, 20)
    vectors = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(made)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(400)]  # copies weigh once
    vectors += [(3, vectors[9][1]), (None, vectors[4][1]), (2000, None), (2001, [float("nan")] * 20), (2002, [None, *[0.5] * 19]), (2003, [float("-inf")] * 20), (2004, [0.0] * 20), (2005, [-0.001, *[1e-9] * 19])]
    df = frame("vec_id long, embedding array<float>, x int, label int, key string", *[(*v, 1, None, "k") for v in vectors]).repartition(5)
    rows = whitening.whitened(df).collect()
    good, n, deviation, value, share = by_hand([(k, v and [None if c is None else float(np.float32(c)) for c in v]) for k, v in vectors])
    assert len(rows) == 16 * len(good)
    flips = {}
    for r in rows:
        some = [i for i, (k, _) in enumerate(good) if k == r.vec_id]
        i = min(some, key=lambda i: (deviation[i] != r.deviation, abs(abs(value[i][r.component - 1]) - abs(r.whitened))))
        assert (r.n, r.deviation) == (n, deviation[i])
        want = value[i][r.component - 1]
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        if abs(want) > 1e-6:
            flips.setdefault(r.component, set()).add(want * r.whitened > 0)
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
    assert all(len(f) == 1 for f in flips.values())


def test_cross_products_by_planes_are_exact():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 33, (150, 5))
    x[:, 2] = 0
    bits = [int(v).bit_length() for v in x.max(axis=0)]
    exact = x.astype(object)
    want = [[int((exact[:, i] * exact[:, j]).sum()) for j in range(5)] for i in range(5)]
    got = whitening.scatter(x, bits)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(i, 5))


def test_whitening_of_few_flat_and_wrong_rows(frame):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(frame(schema, (1, [1.0, 2.0])).limit(0)).count() == 0
    assert whitening.whitened(frame(schema, (1, [1.0, 2.0]), (2, [1.0, 2.0]))).count() == 0
    assert whitening.whitened(frame(schema, (1, []), (2, []))).count() == 0
    # one dimension does not vary, so there is one component
    flat = whitening.whitened(frame(schema, (1, [1.0, 2.0]), (2, [3.0, 2.0]))).orderBy("vec_id").collect()
    assert [(r.component, r.n, round(abs(r.whitened), 12), r.deviation) for r in flat] == [(1, 2, 1.0, 128**2), (1, 2, 1.0, 128**2)]
    with pytest.raises(ValueError, match="different lengths"):
        whitening.whitened(frame(schema, (1, [1.0]), (2, [1.0, 2.0])))
    with pytest.raises(ValueError, match="different lengths"):
        whitening.whitened(frame(schema, (1, [1.0]), (2, [])))
    with pytest.raises(Exception, match="2 to the 52"):
        whitening.whitened(frame(schema, (1, [1e300]), (2, [1.0])))
