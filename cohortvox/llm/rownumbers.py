"""Documents as rows: what a stage does where doc_id does not name one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortvox.llm.prefixsum import prefix_sums
from cohortvox.sources.workspace import Workspace


def ids_name_rows(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own (reads that column only)."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty()


def numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``(doc_id, text, row)``: each row with a number of its own from 0, in the order of (doc_id, hash of the text).

    Null ids come last.  The rows are written, so numbers stay.
    """
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed = prefix_sums(packed, ["id", "hash", "tie"], [], ws)
    return ws.table(placed.select(F.col("rows_before").alias("doc_id"), F.col("row.text").alias("text"), "row"), "numbered")
