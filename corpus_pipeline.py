"""From documents to packed training sequences: each stage is an operator of ``eavista.llm``.

A stage gets the table that the one before it wrote, and works on all of it. Every stage
but the last returns the columns of ``documents``; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eavista.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from eavista.llm.queries import vocabulary
from eavista.llm.shared import stored, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of documents linked by a similarity of 0.8 of their five-word shingles, the first stays."""
    return minhash_dedup.deduplicated(docs, words=5, percent=80)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, those of small sources up to twice."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids in sequences of at most 4096."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", source_weights),
    ("packing", sequences),
]

# Training, sampling orders and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on the table that the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
