"""Mixing sources to target weights by hash-random order and exact budgets.

Native: DataFrame functions only.  Each document gets a hash-random key; within
its source the documents are range-sorted by that key, a distributed prefix sum
counts the words before each, and the sequence is cut at the source's budget
exactly, in whole epochs first and a last partial one.

Budgets: ``SHARE`` of all words is dealt to the sources by weight; a source is
held at ``EPOCHS`` times its words and what it cannot take is dealt again by
weight.  The fixed point is min(cap, level * weight) for one level, which a sort
by cap / weight gives in closed form.

Cases: a null text has 0 words; sources are ordered by code point, null last and
a source of its own; repeated rows are separate documents; a source without
words gets nothing; an empty table gives no rows; other columns are ignored.
Reruns agree: keys depend on the row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortvox.llm.prefixsum import prefix_sums
from cohortvox.sources.workspace import Workspace

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 1234567
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)``, one row per source.

    The windows run over one row per source, after aggregation.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (epochs * F.col("source_size")).cast("double"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumns({
        "budget": share * F.sum("source_size").over(whole),
        "capped": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("budget") - F.col("capped")) / F.col("rest")
    # the first source in this order that the level does not fill sets the level
    free = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("capped"), level.alias("level")))).over(whole)
    target = F.coalesce(F.least("cap", free["level"] * F.col("weight")), F.col("cap"))
    return by.select("source", "source_size", target.alias("target"))


LAST_ID = (1 << 63) - 1


def _key(seed: int, doc_id: Column, size: Column) -> Column:
    """A document's place in its source's order: a hash, then what settles ties."""
    return F.struct(F.xxhash64(F.lit(seed), doc_id, size).alias("hash"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), size.alias("size"))


def _placed(sized: DataFrame, ws: Workspace, weights: tuple[int, ...], share: float, epochs: int, seed: int) -> DataFrame:
    """Adds the source's size and target, its whole epochs, the words left for the last one, and those before."""
    targets = ws.table(source_targets(sized, weights, share, epochs), "targets")
    keyed = sized.withColumn("key", _key(seed, F.col("doc_id"), F.col("size")))
    ordered = prefix_sums(keyed, ["source", "key"], ["size"], ws, group=["source"])
    t = targets.select(F.col("source").alias("__source"), "source_size", "target")
    joined = ordered.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    words = F.floor("target")  # whole words
    full = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0)
    return joined.withColumn("epochs", full).withColumn("left", words - F.col("epochs") * F.col("source_size"))


def mix(sized: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows of (doc_id, source, size)."""
    p = _placed(sized, ws, weights, share, epochs, seed)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("size_before")))
    return p.select(*sized.columns, "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op10")
    sized = ws.table(document_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return mix(sized, ws).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts stay in place.

    The cut is one key per source (the last document that the partial epoch
    reaches), so a document's copies follow from its own key and a row per
    source.  Documents stay whole, the one at the cut included; one without
    words is kept once.
    """
    ws = Workspace(spark, "mix")
    sized = ws.table(document_words(docs), "sizes")
    placed = _placed(sized, ws, WEIGHTS, SHARE, EPOCHS, SEED)
    reached = F.when(F.col("size_before") < F.col("left"), F.col("key"))
    cuts = placed.groupBy(F.col("source").alias("__source")).agg(F.first("epochs").alias("__epochs"), F.max(reached).alias("__cut"))
    cuts = ws.keep(cuts, "cuts")  # Spark broadcasts it if it is small
    sized_docs = docs.withColumn("__size", word_count(F.col("text")))  # counted once a row, below the join
    size = F.col("__size")
    key = _key(SEED, sized_docs["doc_id"].cast("long"), size)
    last = F.coalesce(key <= F.col("__cut"), F.lit(False)).cast("int")
    copies = F.when(size == 0, 1).otherwise(F.col("__epochs").cast("int") + last)
    out = sized_docs.join(cuts, sized_docs["source"].cast("string").eqNullSafe(cuts["__source"]))
    each = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    return out.select(*[sized_docs[c] for c in docs.columns], each.alias("__copy")).drop("__copy")
