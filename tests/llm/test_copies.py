"""Nearest vectors in large groups of equal ones."""

import numpy as np
from tabularium.llm import stable

VECS = "vec_id long, embedding array<float>"


def test_copies_over_many_leaves_and_shards_come_by_key(frame):
    rng = np.random.default_rng(12)
    draw = lambda: [float(np.float32(x)) for x in rng.standard_normal(48)]
    groups = [draw() for _ in range(3)]
    ids = rng.permutation(6000).tolist()
    rows = [(i, groups[at % 3] if at < 4500 else draw()) for at, i in enumerate(ids)]
    group = {i: at % 3 for at, i in enumerate(ids) if at < 4500}
    found = {}
    for r in stable.nearest(frame(VECS, *rows), every=50, shard=512).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in sorted(group) if i % 50 == 0]
    wrong = []
    for i in asked:
        copies = [j for j in sorted(group) if group[j] == group[i] and j != i][:5]
        got = sorted(found[i])
        if [r[1] for r in got] != copies or len({r[2] for r in got}) != 1:
            wrong.append(i)
    assert len(asked) > 50 and not wrong, f"{len(wrong)} of {len(asked)}"


def test_a_group_of_copies_nearest_to_another_vector(frame):
    rng = np.random.default_rng(13)
    centre = rng.standard_normal(48)
    near = [float(np.float32(x)) for x in centre + 0.05 * rng.standard_normal(48)]
    rows = [(0, [float(np.float32(x)) for x in centre])] + [(i, near) for i in range(3000, 0, -1)]
    rows += [(i, [float(np.float32(x)) for x in rng.standard_normal(48)]) for i in range(4001, 4400)]
    got = stable.nearest(frame(VECS, *rows), every=5000, shard=512).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, n, n) for n in range(1, 6)]
    assert len({r.score for r in got}) == 1
