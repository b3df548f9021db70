"""A training corpus in five stages, each of which works on what the one before kept.

Every stage is a function of ``(spark, docs, sf_dir)``; ``run`` applies them to the
documents of a data directory and writes each one's result to the shared folder,
so that no stage depends on the executors of an earlier one.  All but the last
return the columns of ``documents``.  How a stage treats nulls, ties, repeated
rows and empty tables is said at the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textassay.llm.common import materialise, table
from textassay.llm.decontaminate import remove_contamination
from textassay.llm.exact_dedup import drop_exact_duplicates
from textassay.llm.language_id import drop_unknown
from textassay.llm.packing import pack_documents
from textassay.llm.simhash_dedup import drop_near_duplicates


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labelled ones have go, and those without letters."""
    return drop_unknown(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; the documents stay, with their new lengths."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", recognised_language),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("decontaminate", benchmark_passages),
    ("pack", packed_sequences),
]

#: Fingerprints, components and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
