"""Contiguous shards of nearly equal bytes from global byte-size prefix sums.

Law ``bytes``: documents are taken in the order (doc_id, checksum, size), the
bytes before each are a global prefix sum, and the sequence is cut at equal
targets: a document belongs to the shard in which its middle byte lies.  Shards
are therefore contiguous and their sizes differ by less than the two documents
at their ends.

Cases: a null text has 0 bytes and size 1; null ids come last; repeated rows are
separate documents, and rows that tie in the whole order swap freely; a document
beyond a whole target may leave later shards empty; an empty table gives no
rows; other columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.prefixsum import prefix_sums
from cohortvox.sources.workspace import Workspace

SHARDS = 8


def balanced_shards(sized: DataFrame, ws: Workspace, shards: int = SHARDS, order: tuple[str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with a ``size`` of at least one."""
    placed = prefix_sums(sized, list(order), ["size"], ws)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("t")).first().t
    middle = 2 * F.col("size_before") + F.col("size")
    # the middle byte in shard-ths of the total; in decimals, as the product can pass 2^63
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(20,0)") * shards / F.lit(max(1, 2 * total)).cast("decimal(20,0)")).cast("int"))
    placed = ws.table(placed.withColumn("shard", shard), "placed")
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("__first"))  # at most one row a shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rows_before") - F.col("__first")).drop("__first")


def document_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32)``: UTF-8 bytes plus one, and their CRC-32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def op5_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op5")
    sized = ws.table(document_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return balanced_shards(sized, ws).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``shard``; texts stay in place.

    The cuts are the keys at which the shards begin, seven at most, so each row
    finds its shard by comparing its own key.  Rows that tie in the whole order
    share a shard.  A column named shard is replaced.
    """
    ws = Workspace(spark, "shard")
    sized = ws.table(document_sizes(docs), "sizes")
    key = lambda d, c, z: F.struct(F.coalesce(d, F.lit((1 << 63) - 1)).alias("d"), c.alias("c"), z.alias("z"))
    placed = balanced_shards(sized, ws)
    first = placed.groupBy("shard").agg(F.min(key(F.col("doc_id"), F.col("text_crc32"), F.col("size"))).alias("k"))
    cuts = ws.keep(first.agg(F.array_sort(F.collect_list(F.struct("k", "shard"))).alias("__cuts")), "cuts")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = key(F.col("doc_id").cast("long"), F.crc32(text.cast("binary")), (F.octet_length(text) + 1).cast("long"))
    shard = F.element_at(F.filter("__cuts", lambda c: c["k"] <= F.col("__own")), -1)["shard"].cast("int")
    keep = [c for c in docs.columns if c != "shard"]
    return docs.withColumn("__own", own).join(F.broadcast(cuts), F.lit(True)).select(*keep, shard.alias("shard"))
