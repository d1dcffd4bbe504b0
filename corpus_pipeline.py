"""A corpus pipeline: languages, near duplicates, benchmark passages, personal data, packing.

Each stage works on all that the one before it kept and is written as Parquet in the shared folder before
the next one reads it, so a lost executor costs no more than a part of one stage. The tables of the stages
go when the driver ends.

Edge cases: null texts, and texts without a letter, have no language and go with the first stage; rows that
share a doc_id leave one; very long texts are cut into sequences; empty tables stay empty; all columns
but ``lang``, ``text`` and ``n_chars`` pass through as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import decontaminate, langid, neardup, packing, pii
from engramlake.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in known languages, of which the largest becomes their ``lang``, however small its share is."""
    return langid.in_known_language(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return neardup.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: SQL has no trained model and no tokenizer; tests/llm/test_pipeline.py compares the stages with plain re-computations.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
