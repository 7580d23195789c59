"""Bounded samples of labelled documents, as training rows of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, y) of at most ``per_class`` rows of each label outside the held-out fold, those with the least hashes.

    A document labelled more than once counts once, with its largest label. The bound makes the table safe to broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(folds) != held))
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    parts = [known.where(F.col(label) == y).select("doc_id", F.col(label).cast("int").alias("y"))
             .distinct().orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionAll(parts[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
