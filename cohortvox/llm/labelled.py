"""Labelled training rows: the fold rule and a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that a classifier is fitted on at most.
TRAIN_ROWS = 8_000
#: A document longer than this is left out of the sample (never out of scoring).
TRAIN_BYTES = 60_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``(doc_id, y, text)`` of at most ``rows`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 are ignored; of repeated labels the larger counts,
    of several texts with one id the smallest.
    The sample takes the smallest hashes of doc_id, so reruns agree; its ids
    (``rows`` at most) are broadcast to the texts.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").where(F.octet_length("text") <= most_bytes)
    return src.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
