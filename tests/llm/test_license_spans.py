"""Spans of the license scan: what plain prose, changed and cut notices and whole license texts give."""

import random

import pytest
from tabularium.llm import licenses

DOCS = "doc_id long, text string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def labels(frame, docs, **settings):
    found = licenses.scan_digest(licenses.license_spans(frame(DOCS, *enumerate(docs)), **settings)).collect()
    return [r.labels for r in sorted(found, key=lambda r: r.doc_id)]


def test_plain_prose_has_no_label(frame):
    texts = [
        "the cat sat under the table, under the chair, under the bed",
        "licensed under the licensed under the licensed under the",
        "license under the license, under a mit, the license under the",
        "released under the new license of the city, under the mit",
        "licensed under the eclipse public license version 2 0",
        "to any person free of charge, this software is granted; files of a copy and documentation obtaining hereby permission",
        "you may not use this file. you may obtain a copy. of the license at",
        " ".join(reversed(MIT.split())),
        "by the way, cc",
        "under the " * 500,
    ]
    assert labels(frame, texts) == [""] * len(texts)


def test_notices_with_words_changed_put_in_left_out_and_cut(frame):
    rng = random.Random(2)
    said = MIT.split()
    texts = [
        MIT,
        MIT.upper().replace(",", " --\n"),
        " ".join(w for i, w in enumerate(said) if i != 2),
        " ".join([*said[:5], "of any kind of", *said[5:]]),
        " ".join([*said[:3], "x", *said[3:9], "y", *said[9:]]),
        " ".join(said[:15]),  # 14 of 19 pairs
        "of this " * 30 + MIT + " of this" * 30,
        MIT + " and " + MIT,
        " ".join(rng.choices("abcdefgh", k=3000)) + " " + MIT,
    ]
    assert labels(frame, texts) == ["mit"] * len(texts)
    assert labels(frame, [" ".join(said[:9])]) == [""]


def test_spans_tell_where_and_how_much(frame):
    text = "a b c " + MIT + " d. Licensed under CC BY NC 4.0, all rights reserved"
    (row,) = licenses.license_spans(frame(DOCS, (1, text))).collect()
    n = len(licenses_words(MIT))
    assert [(s.label, s.first, s.last, s.score) for s in row.spans if not s.base] == [("cc-by-nc-4.0", n + 4, n + 10, 1.0), ("mit", 3, 3 + n - 1, 1.0)]
    assert sorted((s.label, s.first, s.last) for s in row.spans if s.base) == [("cc-by", n + 6, n + 7), ("reserved", n + 11, n + 13)]


def licenses_words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def chain(hits):
    """Longest chain of hits that rise in text and template, by comparing all pairs."""
    best = {}
    for pos, place in sorted(hits):
        best[pos, place] = 1 + max((n for (a, b), n in best.items() if a < pos and b < place), default=0)
    return max(best.values(), default=0)


def test_scores_equal_chains_by_hand(frame):
    rng = random.Random(7)
    said = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = []
    for _ in range(150):
        words = list(said)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choices(said + ["x", "y"], k=rng.randrange(2))
        texts.append(" ".join(rng.choices(said, k=3) + words + rng.choices(said, k=3)))
    found = licenses.license_spans(frame(DOCS, *enumerate(texts)), base=[], templates=[(" ".join(said), "g")]).collect()
    pairs = list(zip(said, said[1:]))
    for r in found:
        words = texts[r.doc_id].split()
        hits = [(p, i) for p, pair in enumerate(zip(words, words[1:])) for i, q in enumerate(pairs) if pair == q]
        best = 0
        for centre in {p - i for p, i in hits}:
            near = [(p, i) for p, i in hits if abs(p - i - centre) <= 3]
            told = sum(any(i in (j, j - 1) for _, i in near) for j in range(len(said)))
            if len({i for _, i in near}) >= 0.7 * len(pairs) and 2 * told >= len(said):
                best = max(best, chain(near))
        want = best / len(pairs) if best >= 0.7 * len(pairs) else 0
        assert max((s.score for s in r.spans), default=0) == pytest.approx(want)


def test_whole_license_texts_as_a_table(frame):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(400)]
    text, other = " ".join(words[:300]), " ".join(words[300:] + words[:5])
    texts = frame("label string, text string", ("own-1", text), ("own-2", other), (None, "a b c d"), ("none", None), ("one", "word"), ("own-1", text))
    docs = [text, " ".join(words[:100]), " ".join(words[20:60]), "x " * 50 + other, MIT, " ".join(words[:3])]
    assert labels(frame, docs, texts=texts) == ["own-1", "own-1", "", "own-2", "mit", ""]
    assert licenses.sections(texts).where("label = 'own-1'").count() == 5


def test_awkward_rows_and_names(frame):
    docs = frame("`a b` string, `x.y` long, label string, spans string", (None, 1, "l", "s"), ("", 2, "l", "s"), (MIT, 3, None, None), (MIT, 3, None, None), (MIT, None, "l", "s"))
    got = licenses.license_spans(docs, keys=("x.y",), text="a b").collect()
    assert sorted((str(r["x.y"]), r.n_words, [s.label for s in r.spans]) for r in got) == [("1", 0, []), ("2", 0, []), ("3", 20, ["mit"]), ("3", 20, ["mit"]), ("None", 20, ["mit"])]
    with pytest.raises(ValueError, match="2 to 60|words"):
        licenses.listed(docs.sparkSession, [("x", "y")])
    assert licenses.license_spans(docs.limit(0), keys=("x.y",), text="a b").count() == 0
