"""A training-data pipeline from raw documents to token ids, each stage one corpus operator.

The classifier drops documents of low quality, exact copies keep the row with the largest id, near copies the
one with the smallest, the mix repeats or leaves out documents so that every source meets its target, and
the rest is encoded. Every stage sees all that its predecessor kept.

Defined results: all stages take null and empty texts as empty texts, accept empty tables, and carry
extra columns through to the last stage, which returns one row of ids per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from handful.llm import exact_dedup, mixing, near_copies as near_copies_of, pieces, quality
from handful.llm.common import table
from handful.session import cut_lineage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the learning folds."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3, learn_from=table(spark, sf_dir, "documents"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies_of.keep_one_near(docs, words=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mixture(docs, weights=(5, 2, 1), cap=3)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]

# A fitted network, fingerprints and piece merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with a written table between them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs, f"pipeline-{k + 1}")
    return docs
