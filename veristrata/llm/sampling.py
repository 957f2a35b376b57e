"""Bounded, repeatable training samples, and the folds of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds


def train_labels(labels: DataFrame, column: str, folds: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id`` and one label of the rows outside the held-out fold; ids with unequal labels drop out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return rows.groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("_top")).where(F.col(column) == F.col("_top")).drop("_top")


def hashed_share(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """About ``limit`` rows (all, if fewer), chosen by a hash of their key: the same rows each run."""
    total = rows.count()
    if total <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(_SPACE)) < int(_SPACE * limit / total))
