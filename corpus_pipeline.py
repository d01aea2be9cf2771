"""A corpus pipeline over ``documents``: quality rules, quality classifier, near duplicates, mixing, packing.

Each stage works on all that the one before kept and hands on the columns of ``documents``; the last returns packed pieces. Stages are
written as Parquet and read again, so a lost executor costs one stage at most. The near-duplicate stage uses five-word shingles and a
similarity of 0.8. SQL cannot express the classifier, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heapstone.llm import host_rules, mixing, near_dup, packing, quality_cnn
from heapstone.llm.common import Store, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from labelled texts of what is left."""
    return quality_cnn.keep_predicted(docs, quality_cnn.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, near_dup.Likeness(width=5, percent=80, rows=5))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("mixing", source_mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs, store = read(spark, sf_dir, "documents"), Store(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        kept = store.keep(stage(spark, docs, sf_dir))
        store.drop(docs)  # the first is an input, not one of ours, and stays
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
