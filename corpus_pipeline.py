"""A training corpus from raw documents: quality filter, near and substring de-duplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import minhash, packing, quality, substring
from brindle.llm.common import Scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier; a document that loses all of them stays, empty."""
    return substring.cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_filter), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: A trained classifier and a tokenizer are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
