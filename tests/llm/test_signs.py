"""Texts without their repeated passages, where a cut splits a sign."""

import random

from tabularium.llm import suffix

DOCS = "doc_id long, text string, n_chars long"


def left_by_signs(rows, length=100):
    """Texts without the signs that lose a byte."""
    seen, out = set(), []
    for key, text in rows:
        line = text.encode()
        gone = bytearray(len(line))
        for i in range(len(line) - length + 1):
            part = line[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(part)
        kept, at = [], 0
        for sign in text:
            size = len(sign.encode())
            if not any(gone[at : at + size]):
                kept.append(sign)
            at += size
        out.append((key, "".join(kept), len(kept)))
    return out


def test_a_cut_takes_whole_signs_and_no_others(frame):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [
        (1, "é" + line + "é"),  # C3 A9 ... C3 A9
        (2, "own � ũ" + line + "ã tail"),  # C5 [A9 ... C3] A3: the bytes left would be a sign
        (3, "� ũ" + line + "z �"),  # C5 [A9 ...]
        (4, "ũ" + line + "ũ"),
        (5, "\U0001f600" + line + "\U0001f601" + "x"),
        (6, "\U0001f640" + line + "\U0001f601" + "y �"),
    ]
    signs = "éũãţ�日本\U0001f600\U0001f601\U0001f640ab"
    base = "".join(rng.choice(signs) for _ in range(600))
    for i in range(7, 80):
        a = rng.randrange(500)
        text = base[a : a + rng.randrange(20, 100)]
        if i % 2:  # swap a sign for a neighbour that shares bytes with it
            text = text.replace("é", "ũ", 1).replace("\U0001f600", "\U0001f640", 1)
        rows.append((i, "".join(rng.choice(signs) for _ in range(5)) + text + rng.choice(signs)))
    got = suffix.stripped(frame(DOCS, *[(i, t, 0) for i, t in rows])).collect()
    want = left_by_signs(rows)
    wrong = [(tuple(g), w) for g, w in zip(sorted(got), want) if tuple(g) != w]
    assert len(got) == len(want) and not wrong, f"{len(wrong)} of {len(want)}: {wrong[:3]}"
    assert [w[1] for w in want[1:3]] == ["own �  tail", "z �"]
