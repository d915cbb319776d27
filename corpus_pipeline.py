"""The corpus pipeline: quality classifier, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxlake.llm import block_naming, bound_packing, cover_dedup, partition_join, site_quality
from voxlake.llm.common import dropped, table, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return block_naming.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near duplicates: shingles of five words, similarity 0.8 or more."""
    return partition_join.keep_one(docs, k=5, num=80, den=100)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 50 words that a document with a smaller doc_id has."""
    return cover_dedup.remove(docs, length=50, rewrite=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return bound_packing.pack(docs, WORD_BPE, end_id=1, capacity=4096)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("substring_dedup", substring), ("best_fit_packing", packing)]

#: SQL has no tokenizer or trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what the next one has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = written(stage(spark, docs, sf_dir), spark)
        if k:
            dropped(docs)
        docs = kept
    return docs
