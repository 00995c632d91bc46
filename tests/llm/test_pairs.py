"""SimHash, vector search and vector near-duplicates against brute force, and components of graphs."""

import random
import re

import numpy as np
import pytest
import xxhash
from tabularium.llm import components, crosspolytope, simhash, stable, vectors

DOCS = "doc_id long, text string, _row string, fp string"


def reach(nodes, linked):
    """Smallest node reachable from every node."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    rng = random.Random(3)
    words = ["Äpfel", "the", "Of", "and", "tree", "a", "stone", "ÉTÉ", "x\xa0y"]
    out = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(60)]
    base = " ".join(rng.choices(words, k=400))
    out += [base, base + " end", "start " + base, base.upper(), base.replace("tree", "trees", 1)]
    return out + ["", None, " \t\n", "one", "one two", "ONE two", "w " * 30000]


def test_fingerprints_and_groups_are_those_of_brute_force(frame):
    rows = [(i * 3 + 7, t, "r", "f") for i, t in enumerate(texts())]
    got = simhash.components(frame(DOCS, *rows)).collect()
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    low = reach(prints, linked)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", low[i]) for i, p in prints.items()}
    assert len(got) == len(rows)


def test_missing_keys_and_repeated_rows(frame):
    rows = [(None, "same words here now", "", ""), (5, "same words here now", "", ""), (5, "same words here now", "", ""), (None, "quite another text is this", "", "")]
    got = simhash.components(frame(DOCS, *rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    kept = simhash.deduplicated(frame(DOCS, *rows))
    assert kept.columns == ["doc_id", "text", "_row", "fp"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]


def test_empty_tables(frame):
    assert simhash.components(frame(DOCS, (1, "a", "", "")).limit(0)).count() == 0
    assert simhash.deduplicated(frame(DOCS, (1, "a", "", "")).limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [16, 4096])
def test_large_buckets_lose_no_link(spark, bucket):
    rng = random.Random(5)
    values = set()
    for centre in (0, rng.getrandbits(64), (1 << 64) - 1):
        for _ in range(200):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))))
    values = sorted(values)
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = components.connected_components(simhash.links(prints, 3, bucket)).collect()
    linked = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    low = reach(values, linked)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for v in values:
        want.setdefault(low[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_close_pairs_by_bit_planes():
    rng = np.random.default_rng(1)
    for radius in (1, 3, 4, 7):
        values = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
        values[75:] = values[:75] ^ (np.uint64(1) << rng.integers(0, 64, 75).astype(np.uint64)) ^ rng.integers(0, 1 << 5, 75, dtype=np.uint64)
        end = np.full(150, 150)
        end[:40] = 40
        got = {(int(a), int(b)) for left, right in simhash.close_pairs(values, end, radius) for a, b in zip(left, right)}
        want = {(i, j) for i in range(150) for j in range(i + 1, end[i]) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert got == want


def test_components_of_chains_and_stars(frame):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 40)]
    got = {r.node: r.component for r in components.connected_components(frame("a long, b long", *edges)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, **{100 + i: 100 for i in range(30)}}
    assert components.connected_components(frame("a long, b long", (1, 1))).count() == 0


VECS = "vec_id long, embedding array<float>, label int, node string, code string"


def near_rows(n=120, dim=20, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, dim))
    rows = []
    for i in range(n):
        v = centre[i % 8] + rng.standard_normal(dim) * (0.04 if i % 3 else 1.0)
        rows.append([i, [float(np.float32(x)) for x in v], int(i % 2), "", ""])
    rows += [[900, rows[5][1], rows[5][2], "", ""], [901, rows[5][1], rows[5][2], "", ""], [902, rows[5][1], 1 - rows[5][2], "", ""]]
    rows += [[903, None, 1, "", ""], [904, [0.0] * dim, 1, "", ""], [905, [float("nan")] * dim, 1, "", ""], [906, [None] * dim, 1, "", ""]]
    rows += [[907, rows[5][1], None, "", ""], [908, [1e30] * dim, 0, "", ""], [909, [1e-30] * dim, 0, "", ""], [910, [float("inf")] * dim, 0, "", ""]]
    return rows


def sound(row):
    v = row[1]
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosines(rows):
    x = np.array([r[1] for r in rows], float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


@pytest.mark.parametrize("bucket", [2048, 8])
def test_vector_links_are_those_of_brute_force(frame, bucket):
    rows = near_rows()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in crosspolytope.near_vectors(frame(VECS, *rows), bucket=bucket).collect()}
    good = [r for r in rows if sound(r) and r[2] is not None]
    c = cosines(good)
    linked = [(a[0], b[0]) for i, a in enumerate(good) for j, b in enumerate(good) if i < j and a[2] == b[2] and c[i, j] >= 0.98]
    low = reach([r[0] for r in rows], linked)
    want = {r[0]: (sum(r[0] in pair for pair in linked), low[r[0]], low[r[0]] == r[0]) for r in rows}
    assert len(linked) > 100
    assert got == want


def test_vectors_without_a_partner_and_empty(frame):
    assert crosspolytope.near_vectors(frame(VECS, [1, [1.0], 1, "", ""]).limit(0)).count() == 0
    one = crosspolytope.near_vectors(frame(VECS, [1, [1.0, 2.0], 1, "", ""], [None, [1.0, 2.0], 1, "", ""], [None, [9.0, -2.0], 1, "", ""])).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in one) == [("1", 1, "1", True), ("None", 0, "None", False), ("None", 1, "1", False)]
    with pytest.raises(ValueError):
        crosspolytope.near_vectors(frame(VECS, [1, [1.0], 1, "", ""], [2, [1.0, 2.0], 1, "", ""]))


def test_nearest_vectors(frame):
    rng = np.random.default_rng(4)
    rows = [[i, [float(np.float32(x)) for x in rng.standard_normal(24)], 0, "", ""] for i in range(700)]
    rows += [[800, rows[1][1], 0, "", ""], [801, None, 0, "", ""], [850, [0.0] * 24, 0, "", ""], [None, rows[1][1], 0, "", ""]]
    got = {}
    for r in stable.nearest(frame(VECS, *rows), every=10, shard=256).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [r for r in rows if sound(r) and r[0] is not None]
    c, ids = cosines(good), np.array([r[0] for r in good])
    hit = 0
    assert set(got) == {i for i in ids.tolist() if i % 10 == 0}
    for i, q in enumerate(ids.tolist()):
        if q % 10:
            continue
        score = c[i].copy()
        score[i] = -2
        best = np.lexsort((ids, -score))[:5]
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hit += len({f[1] for f in found} & set(ids[best].tolist()))
        where = {int(v): float(s) for v, s in zip(ids, score)}
        assert all(abs(f[2] - where[f[1]]) < 1e-12 for f in found)
    assert hit >= 0.9 * 5 * len(got)


def test_few_candidates_ties_and_empty(frame):
    same = [1.0, 0.0]
    got = stable.nearest(frame(VECS, [0, same, 0, "", ""], [9, same, 0, "", ""], [4, same, 0, "", ""], [4, same, 0, "", ""]), every=50).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 4, 1.0), (0, 2, 9, 1.0)]
    assert stable.nearest(frame(VECS, [0, same, 0, "", ""]).limit(0)).count() == 0
    assert stable.nearest(frame(VECS, [0, same, 0, "", ""])).count() == 0


def test_chi_square_quantile():
    assert abs(stable.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(stable.chi_square_quantile(0.99, 2) - 9.210) < 1e-3
    assert abs(stable.chi_square_quantile(0.98, 7) - 16.622) < 1e-3
    assert abs(stable.chi_square_quantile(0.98, 1) - 5.412) < 1e-3


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 32))
    assert np.allclose(np.linalg.norm(crosspolytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(crosspolytope.hadamard(crosspolytope.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(vectors.unit(x), axis=1), 1)
