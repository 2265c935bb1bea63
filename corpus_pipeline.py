"""Corpus pipeline: documents to packed training sequences.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of
``documents``.  Columns beyond ``doc_id``, ``text`` and ``n_chars`` pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from solvens.llm import exact_dedup, lsh_forest, packing, suffix_dedup, toxicity
from solvens.llm.common import table
from solvens.session import materialise, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't call toxic."""
    ship_package(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near duplicates."""
    ship_package(spark)
    return lsh_forest.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 400 bytes or of more than 50 words that occur elsewhere; ``n_chars`` follows the text."""
    ship_package(spark)
    return suffix_dedup.without_repeats(docs, units=(suffix_dedup.BYTES, suffix_dedup.PASSAGES))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Learnt scores, near duplicates and best-fit packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
