"""A training corpus from documents: quality, toxicity, near-duplicates, benchmark leaks, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellsift.llm import bpe, decontaminate, ngram_join, quality, toxicity
from cellsift.llm.common import discard, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels"), quality.may_learn()))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network doesn't find toxic."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.may_learn()))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("quality", good), ("toxicity", civil), ("near_duplicates", distinct), ("decontamination", untested), ("byte_bpe", encoded)]

#: Models and similarity joins are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(last)
    return docs
