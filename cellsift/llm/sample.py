"""Bounded samples of labelled documents, and folds by a checksum of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.llm.common import written


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def labelled(documents: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str], keep: Column | None = None) -> DataFrame:
    """doc_id, label (0 or 1), of_label and columns of at most per_class documents of each class, chosen by a hash of doc_id.

    of_label: documents that have that label in all. A doc_id with contradicting labels counts as 1. The ids that are sent
    to all executors are so many at most.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = chosen[0].union(chosen[1]).join(F.broadcast(rows.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))), "label")
    return written(documents.select("doc_id", *columns).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "of_label", *columns), "sample")
