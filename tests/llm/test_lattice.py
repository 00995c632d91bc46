"""The lattice as relations against the library and against the form of the query."""

import public_tokenizers
import sentencepiece as library
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tabularium.llm import lattice, sentencepiece
from tabularium.llm.queries import vocabulary

ODD = ["", None, " ", "  a  b\n\nc\t ", "it's We'LL 'S", "<s>x</s>", "日本語 ١٢ \U0001f600", "á́ x y", "x" * 60, "a\0b \r\n ();", "▁ ▁a▁b", "words and words"]


def test_relations_give_the_ids_of_the_library(frame, spark):
    processor = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [*enumerate(ODD), (None, "plain words"), (3, ODD[3])]
    docs = frame("doc_id long, text string, ids string, row int", *[(*r, "x", 1) for r in rows])
    got = lattice.encode(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in got) == sorted(repr((k, processor.encode(t or ""))) for k, t in rows)
    assert lattice.encode(docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_both_forms_and_the_library_agree_on_documents(spark):
    processor = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: processor.encode(r.text) for r in docs.collect()}
    model = vocabulary("piece_bpe_32k.model")
    assert {r.doc_id: r.ids for r in sentencepiece.encode(docs, model).select("doc_id", "ids").collect()} == want
    assert {r.doc_id: r.ids for r in lattice.encode(docs, model).collect()} == want


def test_the_query_gives_the_ids_of_the_library_on_all_documents(spark):
    processor = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_ids, r.ids, r.exact) for r in sentencepiece.encoded_rows(docs, vocabulary("piece_bpe_32k.model")).collect()}
    for r in docs.collect():
        ids = processor.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), ids, processor.decode(ids) == (r.text or ""))


def unigram():
    """A small unigram vocabulary with the rules of the public one."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(vocabulary("piece_bpe_32k.model"))
    kept = [p for p in model.pieces if p.type != 1]
    del model.pieces[:]
    model.pieces.extend(kept)
    for name, score in {"▁": -3, "a": -2, "b": -2.5, "c": -4, "ab": -3, "bc": -3.25, "abc": -6.5, "▁a": -2.25, "▁ab": -5, "ca": -4.125}.items():
        model.pieces.add(piece=name, score=score, type=1)
    model.trainer_spec.model_type = 1
    return model.SerializeToString()


def test_viterbi_as_a_fold(frame):
    model = unigram()
    processor = library.SentencePieceProcessor(model_proto=model)
    texts = ["abcab", "a b c", "abc abcab ca", "cab bac", "aé b", "bcbcbc aaaa", "ab  ab"]
    got = {r.doc_id: r.ids for r in lattice.encode(frame("doc_id long, text string", *enumerate(texts)), model).collect()}
    assert got == {i: processor.encode(t) for i, t in enumerate(texts)}


def test_the_relations_have_no_python(frame):
    plan = lattice.encode(frame("doc_id long, text string", (1, "a")).withColumn("text", F.upper("text")), vocabulary("piece_bpe_32k.model"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
