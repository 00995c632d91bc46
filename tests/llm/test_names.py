"""Columns of any name, and columns that are called like what an operator adds."""

import sys

import pytest
from pyspark.sql import functions as F
from tabularium.llm import bitsliced, bpe, crosspolytope, licenses, mixing, ordering, sentencepiece, simhash, stable, suffix, token_counts, toxicity, whitening
from tabularium.llm.queries import vocabulary

sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

ODD = "doc_id long, text string, lang string, source string, n_chars long, `a b` int, `a.b` string, `c``d` double"
ADDED = ["doc", "row", "key", "id", "hash", "score", "held_out", "predicted", "evidence", "spans", "kept", "lost", "d", "r", "n_tokens", "weight", "epoch", "block", "at", "turn", "fp", "label", "_row", "_source", "_hash"]
ROW = (1, "some words of a text", "en", "s", 20, 3, "x", 0.5)


@pytest.fixture()
def docs(frame):
    df = frame(ODD, ROW, (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, "y", 0.0), (None, "other words here", "en", "t", 1, 1, "z", 1.0), ROW)
    return df.withColumns({name: F.lit(f"own {name}") for name in ADDED})


@pytest.fixture()
def labels(frame):
    return frame("doc_id long, quality int, toxic int, `a b` int, score int", (1, 0, 0, 1, 1), (2, 0, 1, 1, 1), (None, 1, 1, 1, 1), (3, None, None, 1, 1))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_columns_of_any_name(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    rows = out.collect()
    assert rows
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in rows:
            assert [r[name] for name in ADDED] == [f"own {name}" for name in ADDED]
            assert r["doc_id"] != 1 or (r["a b"], r["a.b"], r["c`d"]) == (3, "x", 0.5)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_operators_refuse_columns_they_would_double(docs, labels):
    for name in ("score", "held_out", "predicted", "evidence", "Score"):
        with pytest.raises(ValueError, match="columns exist"):
            toxicity.toxicity(docs.select("doc_id", "text", F.lit(1).alias(name)), labels)
    for name in ("spans", "kept"):
        with pytest.raises(ValueError, match="columns exist"):
            suffix.repeats(docs.select("doc_id", "text", name))
    with pytest.raises(ValueError, match="exists"):
        sentencepiece.encode(docs.withColumn("ids", F.lit(1)), vocabulary("piece_bpe_32k.model"))


def test_keys_and_texts_of_any_name(frame, labels, tmp_path):
    df = frame("`k.1` long, `t x` string, `s``y` string, other int", (1, "some words of a text", "a", 1), (2, None, None, 1), (4, "more words", "b", 1))
    named = {"key": "k.1", "text": "t x"}
    spec, model = vocabulary("word_bpe_49k.json").decode(), vocabulary("piece_bpe_32k.model")
    assert token_counts.token_counts(df, spec, **named).columns[0] == "k.1"
    assert bpe.digest(bpe.encode(df, spec, decoded=True, **named), "k.1").count() == 3
    assert sentencepiece.encoded_rows(df, model, **named).count() == 3
    assert sentencepiece.encode(df, model, text="t x").count() == 3
    assert simhash.components(df, **named).count() == 3 and simhash.deduplicated(df, **named).columns == df.columns
    assert suffix.digest(suffix.repeats(df, **named), "k.1", "t x").count() == 3
    assert suffix.stripped(df, size=None, **named).columns == df.columns
    assert mixing.remixed(df, evenness=0.5, source="s`y", **named).columns == df.columns
    assert licenses.license_spans(df, keys=("k.1",), text="t x").count() == 3
    assert ordering.ordered(df, f"{tmp_path}/shards", **named).count() == 2
    assert toxicity.toxicity(df, labels, label_key="doc_id", **named).count() == 3
    items = frame("`i d` long, `t x` string", (1, "words"))
    assert bitsliced.search(df, items, item_key="i d", item_text="t x", **named).columns == ["i d", "rank", "k.1", "score"]
    vectors = frame("`v.k` long, `e 1` array<double>, `l``b` int", (50, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1))
    both = {"key": "v.k", "vec": "e 1"}
    assert stable.nearest(vectors, **both).count() == 2
    assert crosspolytope.near_vectors(vectors, label="l`b", **both).count() == 3
    assert whitening.whitened(vectors, **both).columns[0] == "v.k"
