"""The operators applied to whole tables: one query each, and SQL where SQL can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, bpe, crosspolytope, licenses, mixing, ordering, sentencepiece, simhash, stable, suffix, token_counts, toxicity, whitening
from .storage import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> bytes:
    """A vocabulary file, read where the query is planned; executors get its bytes with their tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: three-word shingles, three bits."""
    return simhash.components(table(spark, sf_dir, "documents"))


@query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth one, against all rows."""
    return stable.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at cosine 0.98 within a label."""
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op9_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id <= coalesce(low.b, vec_id) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN many ON many.a = vec_id
"""


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan_digest(licenses.license_spans(table(spark, sf_dir, "documents")))


ORACLES["op4_licenses"] = licenses.scan_sql()


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").decode())


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the piece vocabulary, and whether they decode to it."""
    return sentencepiece.encoded_rows(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that start earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.digest(suffix.repeats(docs))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))


@query
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte sequences of all documents in training order, as read back from their shards."""
    return ordering.ordered(table(spark, sf_dir, "documents"), shared_path(spark, "shards"))


@query
def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed by source, half way between the sources as they are and equal ones; no document is lost."""
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), evenness=0.5)
    return mixed.select("doc.doc_id", "doc.source", "n_tokens", "weight", "epoch", "block", "at", "turn")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item, by integer rank scores."""
    return bitsliced.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = bitsliced.search_sql()


@query
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document under the word-level vocabulary, and of what they decode to."""
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").decode(), decoded=True))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the sixteen components of the largest variance, scaled to unit variance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
