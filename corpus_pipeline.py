"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of ``documents``; the
last one gives their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm import mixing, sentencepiece, simhash, suffix, toxicity
from tabularium.llm.queries import vocabulary
from tabularium.llm.storage import settled, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.tolerable(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (three-word shingles, three bits) the document with the smallest id."""
    return simhash.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes and more that an earlier one has."""
    return suffix.stripped(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources several times: half way from the sources as they are to equal ones."""
    return mixing.remixed(docs, evenness=0.5)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids."""
    return sentencepiece.encode(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-duplicates", without_near_copies),
    ("repeated passages", without_repeats),
    ("mixture", mixed),
    ("sentencepiece", encoded),
]
#: No stage before the last can be stated in SQL in full; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each from the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
