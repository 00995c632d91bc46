"""A toxicity score can be recomputed from its evidence."""

import zlib

from tabularium.llm import toxicity
from test_texts import DOCS, labelled


def test_evidence_holds_every_neighbour_that_votes(frame):
    docs, marks = labelled(300)
    got = toxicity.toxicity(frame(DOCS, *docs), frame("doc_id long, quality int, toxic int", *marks)).collect()
    learned = [t for i, _, t in marks if zlib.crc32(str(i).encode()) % 5]
    rate, sizes = sum(learned) / len(learned), []
    for r in got:
        if not r.evidence:
            continue
        sizes.append(len(r.evidence))
        assert [e.cosine for e in r.evidence] == sorted((e.cosine for e in r.evidence), reverse=True)
        assert all(dict((i, t) for i, _, t in marks)[e.doc_id] == e.mark for e in r.evidence)
        votes = [1 / (1 - e.cosine + 0.05) for e in r.evidence]
        score = (sum(v for v, e in zip(votes, r.evidence) if e.mark) + 8.0 * rate) / (sum(votes) + 8.0)
        assert abs(score - r.score) < 1e-9, r
    assert max(sizes) == 15
