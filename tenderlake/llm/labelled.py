"""Labels for the classifiers: which rows may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text leaves the remainder ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, column: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold; a document with conflicting or null labels has none."""
    return (labels.select("doc_id", F.col(column).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
            .where("label = other").drop("other"))
