"""Slices of a case and the colours of their overlays (the data of a picture, not the picture)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortvox.operators.masks import region

#: Red, green and blue of each label, in overlays of the older labels and in comparisons.
OVERLAY = {1: (1, 0, 0), 2: (0, 1, 0), 4: (0, 0, 1)}
COMPARISON = {0: (0, 0, 0), 1: (255, 0, 0), 2: (0, 255, 0), 3: (0, 0, 255), 4: (255, 255, 0)}
ALPHA = 0.4


def best_slice(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """``(case_id, z, n)``: the slice with the most voxels of the mask (the tumour), the lowest on ties."""
    n = df.where(region("wt") if mask is None else mask).groupBy("case_id", "z").agg(F.count("*").alias("n"))
    return n.groupBy("case_id").agg(F.max_by(F.struct("z", "n"), F.struct("n", -F.col("z"))).alias("b")).select("case_id", "b.z", "b.n")


def _spaced(first: Column, last: Column, k: Column) -> Column:
    """``k`` evenly spaced whole numbers from ``first`` to ``last``, truncated, without repeats."""
    step = (last - first) / F.greatest(k - 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(first + i * step)))


def even_slices(df: DataFrame, most: int = 12, mask: Column | None = None) -> DataFrame:
    """``(case_id, z)``: up to ``most`` evenly spaced ones of the slices that hold the mask (the tumour)."""
    w = Window.partitionBy("case_id")
    s = df.where(region("wt") if mask is None else mask).select("case_id", "z").distinct()
    s = s.withColumn("k", F.row_number().over(w.orderBy("z")) - 1).withColumn("n", F.count("*").over(w))
    picks = _spaced(F.lit(0), F.col("n") - 1, F.least("n", F.lit(most)).cast("int"))
    return s.where(F.array_contains(picks, F.col("k").cast("long"))).select("case_id", "z")


def middle_slices(geometry: DataFrame, k: int = 9) -> DataFrame:
    """``(case_id, z)``: ``k`` evenly spaced slices of the middle half of a case's depth."""
    n = F.col("nz")
    return geometry.select("case_id", F.explode(_spaced(F.floor(n / 4), F.floor(3 * n / 4), F.lit(k))).alias("z"))


def colour(label: Column, table: dict[int, tuple[int, int, int]] | None = None) -> Column:
    """A label's (red, green, blue); null for a label without one."""
    pairs = [F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for kv in (table or COMPARISON).items() for x in kv]
    return F.create_map(*pairs)[label]


def overlay(df: DataFrame, value: str, seg: str = "seg", alpha: float = ALPHA, table: dict[int, tuple[int, int, int]] | None = None) -> DataFrame:
    """``df`` with ``rgb``: the value from 0 to 1 within its slice, blended with the colour of the voxel's label."""
    w = Window.partitionBy("case_id", "z")
    low, v = F.min(value).over(w), F.col(value)
    grey = (v - low) / (F.max(value).over(w) - low + 1e-8)
    c = colour(F.col(seg), table or OVERLAY)
    return df.withColumn("__grey", grey).withColumn("rgb", F.when(c.isNull(), F.array_repeat("__grey", 3)).otherwise(
        F.transform(c, lambda x: (1 - alpha) * F.col("__grey") + alpha * x))).drop("__grey")
