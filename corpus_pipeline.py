"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Stages work on every
row they are given: a null text counts as empty, rows with equal or null doc_id are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import near_copies, packing, quality, secret_scan, suffixes
from starloom.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, learned from ``labels``, score 0.5 or more."""
    return quality.filter_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest doc_id."""
    return near_copies.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand at several places are cut out of every text."""
    return suffixes.remove_repeats(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, found by patterns and by the tagger, are masked."""
    return secret_scan.mask_secrets(docs, secret_scan.fit_secrets(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024: one row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Trained models, components and suffix arrays are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
