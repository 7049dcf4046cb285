"""The voxel table: one row per voxel, keyed by case and grid position.

``voxel_view`` derives a cohort of labelled volumes from ``lineitem``; real
cohorts come from ``sources.ingest``.  ``dense`` completes every case's grid, so
that missing cells are background with zero intensity.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.sources.workspace import stored

#: The derived cohort's grid and spacing in millimetres.
SHAPE = (16, 16, 12)
SPACING = (1.0, 1.0, 1.5)
SEQUENCES = ("t1", "t1ce", "t2", "flair")

#: Runs in Spark SQL and in DuckDB.
VIEW = """SELECT case_id, x, y, z, t1, t1ce, t2, flair,
 CASE WHEN d2+nz<10 THEN 1 WHEN d2+nz<24 THEN 3 WHEN d2+nz<44 THEN 2 WHEN nz=6 AND x<4 THEN 2 ELSE 0 END AS seg_gt,
 CASE WHEN d2+nz2<10 THEN 1 WHEN d2+nz2<24 THEN 3 WHEN d2+nz2<44 THEN 2 WHEN nz2=6 AND x<4 THEN 2 ELSE 0 END AS seg_pred
FROM (SELECT *, (x-8)*(x-8)+(y-8)*(y-8)+(z-6)*(z-6) AS d2, CAST(q AS BIGINT)%7 AS nz, (CAST(q AS BIGINT)+n)%7 AS nz2 FROM (
 SELECT CAST(floor(l_orderkey/3750.0) AS BIGINT) AS case_id, l_partkey%16 AS x, CAST(floor(l_orderkey/4.0) AS BIGINT)%16 AS y,
 (CAST(floor(l_partkey/16.0) AS BIGINT)+l_linenumber)%12 AS z,
 sum(l_quantity) AS q, count(*) AS n, sum(l_quantity) AS t1, sum(l_quantity*(1+l_tax)) AS t1ce, max(l_quantity) AS t2, min(l_quantity) AS flair
 FROM lineitem GROUP BY 1,2,3,4))"""


def voxel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived voxels (sparse), with ``seg`` the ground truth."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cols = "case_id, x, y, z, t1, t1ce, t2, flair, CAST(seg_gt AS INT) AS seg_gt, CAST(seg_pred AS INT) AS seg_pred"
    return spark.sql(f"SELECT {cols} FROM ({VIEW.replace('FROM lineitem', 'FROM {lineitem}')})", lineitem=lineitem).withColumn("seg", F.col("seg_gt"))


def volumes(voxels: DataFrame, shape=SHAPE, spacing=SPACING) -> DataFrame:
    """One row of geometry per case."""
    names = ("nx", "ny", "nz", "dx", "dy", "dz")
    values = (*[int(s) for s in shape], *[float(s) for s in spacing])
    return cells_of(voxels.select("case_id").distinct().select("case_id", *[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)]), math.prod(values[:3]))


def cells_of(geometry: DataFrame, most: int) -> DataFrame:
    """``geometry`` that says in ``nx`` how many cells a case has at most; grids made with it keep that."""
    return geometry.withColumn("nx", F.col("nx").alias("nx", metadata={"most_cells": most}))


def most_cells(df: DataFrame) -> float:
    """How many cells a case of ``df`` has at most, as ``cells_of`` has it; infinite where the table does not say."""
    return df.schema["nx"].metadata.get("most_cells", math.inf) if "nx" in df.columns else math.inf


def dense(voxels: DataFrame, geometry: DataFrame) -> DataFrame:
    """Every cell of every case's grid, with the geometry columns.

    The join is on the whole voxel key, so a case spreads over all tasks.
    """
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = geometry.withColumn("x", axis("nx")).withColumn("y", axis("ny")).withColumn("z", axis("nz"))
    for a in "xyz":
        cells = cells.withColumn(a, F.col(a).cast("long"))
    rest = [c for c in voxels.columns if c not in ("case_id", "x", "y", "z")]
    out = cells.join(voxels, ["case_id", "x", "y", "z"], "left")
    return out.select("case_id", "x", "y", "z", *geometry.columns[1:], *[F.coalesce(F.col(c), F.lit(0)).cast(voxels.schema[c].dataType).alias(c) for c in rest])


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cohort as dense grids, stored once for each application and state of its input."""

    def build(folder: str) -> None:
        v = voxel_view(spark, sf_dir)
        dense(v, volumes(v)).write.mode("overwrite").parquet(folder)

    return spark.read.parquet(stored(spark, "grid", [f"{sf_dir}/lineitem.parquet"], build))


def voxel_cm3():
    return F.col("dx") * F.col("dy") * F.col("dz") / 1000
