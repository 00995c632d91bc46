"""Plain versions of toxicity, SimHash groups, repeated passages and mixing, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


def terms_of(text):
    """Terms of a text with their counts: whole words and their beginnings of four to six signs."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update([word + "$", *(word[:n] for n in (4, 5, 6) if n <= len(word))])
    return out


def marking(counts, rate, least, share):
    """(G, term) of terms that mark label 1; counts: term to (all, ones)."""
    rate, out = min(max(rate, 1e-9), 1 - 1e-9), []
    for term, (n, ones) in counts.items():
        g = 2 * sum(x * math.log(x / (n * r)) for x, r in ((ones, rate), (n - ones, 1 - rate)) if x)
        if ones / n >= max(share, rate) and g >= least:
            out.append((g, term))
    return out


def toxicity(docs, labels, least=18.0, share=0.5, k=15, soft=0.05, prior=8.0, vocabulary=4096):
    """(key, score, neighbours (key, cosine, mark)) of every document, comparing it with all examples."""
    known = {}
    for key, mark in labels:
        if key is not None and mark in (0, 1) and not held_out(key):
            known[key] = max(mark, known.get(key, 0))
    examples = [(key, text, known[key]) for key, text in docs if key in known]
    ones = sum(m for *_, m in examples)
    chosen = []
    if examples and 0 < ones < len(examples):
        counts = defaultdict(lambda: [0, 0])
        for _, text, mark in examples:
            for t in terms_of(text):
                counts[t][0] += 1
                counts[t][1] += mark
        candidates = {t for _, t in marking(counts, ones / len(examples), least, share)}
        places = set()
        for _, text, mark in examples:
            words = ["", *re.findall(r"[^\W\d_]+", (text or "").lower()), ""]
            for a, w, b in zip(words, words[1:], words[2:]):
                places |= {(t, mark, a + " " + b) for t in terms_of(w) if t in candidates}
        counts = defaultdict(lambda: [0, 0])
        for t, mark, _ in places:
            counts[t][0] += 1
            counts[t][1] += mark
        size = [len((text or "").encode()) for _, text, _ in examples]
        rate = sum(s for s, (*_, m) in zip(size, examples) if m) / max(1, sum(size))
        chosen = [t for _, t in sorted(marking(counts, rate, least, share), key=lambda x: (-x[0], x[1]))][:vocabulary]
    number = {t: i for i, t in enumerate(chosen)}
    bags = [{number[t]: n for t, n in terms_of(text).items() if t in number} for _, text in docs]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in range(len(chosen))}

    def vector(bag):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    fitted = [(key, known[key], bag) for (key, _), bag in zip(docs, bags) if key in known]
    rate = sum(m for _, m, _ in fitted) / len(fitted) if fitted else 0.0
    bare = [m for _, m, bag in fitted if not bag]
    none = (sum(bare) + rate) / (len(bare) + 1) if fitted else 0.0
    stored = {key: (mark, vector(bag)) for key, mark, bag in fitted if bag}
    order = lambda item: (-item[1], max((x, -t) for t, x in stored[item[0]][1].items())[1] * -1, -max(stored[item[0]][1].values()), item[0])
    out = []
    for (key, _), bag in zip(docs, bags):
        own, near = vector(bag) if bag else {}, []
        for other, (_, w) in stored.items():
            cosine = sum(x * w.get(t, 0.0) for t, x in own.items())
            if cosine > 0:
                near.append((other, min(round(cosine, 12), 1.0)))
        near = sorted(near, key=order)[:k]
        votes = [1 / (1 - c + soft) for _, c in near]
        score = (sum(v * stored[o][0] for v, (o, _) in zip(votes, near)) + prior * rate) / (sum(votes) + prior) if near else none
        out.append((key, score, [(o, c, stored[o][0]) for o, c in near]))
    return out


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def without_near_copies(rows):
    """Of rows (key, text, ...) with distinct keys, those with the smallest key of their group."""
    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                group[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return [r for i, r in enumerate(rows) if root(i) == i]


def without_repeats(rows, length=100):
    """Rows (key, text, ...) with their texts cut, in the order of their keys; a sign that loses bytes goes whole."""
    seen, out = set(), []
    for key, text, *rest in sorted(rows, key=lambda r: r[0]):
        line = (text or "").encode()
        gone = bytearray(len(line))
        for i in range(len(line) - length + 1):
            part = line[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(part)
        kept, at = "", 0
        for sign in text or "":
            size = len(sign.encode())
            kept += "" if any(gone[at : at + size]) else sign
            at += size
        out.append((key, kept, *rest))
    return out


def passes(rows, evenness, hashes, orders, turns):
    """How often each row (key, source, text) is taken.

    ``hashes``: of every row; ``orders(source, epoch, block)`` and ``turns(epoch, hash)``: the keyed orders of blocks and rows.
    """
    tokens = [len(re.findall(r"[^ \t\n\x0b\f\r]+", text or "")) for _, _, text in rows]
    total = Counter()
    for (_, source, _), n in zip(rows, tokens):
        total[source or ""] += n
    every = sum(total.values())
    share = {s: n / every for s, n in total.items() if n}

    def mix(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in mix(a).values())

    target, low, high = entropy(1) + evenness * (entropy(0) - entropy(1)), 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) >= target else (low, middle)
    weight = mix(1.0 if entropy(1) >= target else low)
    budget = max(total[s] / w for s, w in weight.items())
    out = []
    taken = {}
    for s, w in weight.items():
        quota = math.floor(w * budget + 0.5)
        whole, rest = divmod(quota, total[s])
        own = [i for i, r in enumerate(rows) if (r[1] or "") == s]
        own.sort(key=lambda i: (orders(s, whole, hashes[i] % 1024), turns(whole, hashes[i])))
        extra, held = set(), 0
        for i in own:  # rows of one place are taken together
            same = [j for j in own if hashes[j] == hashes[i]]
            if i in extra:
                continue
            if held + sum(tokens[j] for j in same) > rest:
                break
            held += sum(tokens[j] for j in same)
            extra |= set(same)
        for i in own:
            taken[i] = whole + (i in extra)
    for i in range(len(rows)):
        out.append(taken.get(i, 1))
    return out
