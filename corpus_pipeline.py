"""Corpus pipeline: documents that are in a known language, unlike any other
and free of benchmark items, packed into training sequences.

Each stage's result is written as Parquet and read again as the next one's
documents; every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderlake.llm import decontaminate, exact, jaccard, language, packing
from tenderlake.llm.common import cut, table
from tenderlake.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    return language.drop_rejected(docs)


def unlike_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id."""
    return exact.drop_exact(docs)


def unlike_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id."""
    return jaccard.one_per_class(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("exact_dedup", unlike_exactly),
    ("near_dedup", unlike_nearly),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: SQL expresses neither the language models nor the packing; tests/llm holds the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
