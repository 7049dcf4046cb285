"""Global prefix sums over a total order, from per-partition totals.

Rows are range-partitioned by the order and written once, so that partition
numbers are final.  One aggregate gives each partition's totals (a row per
partition and group), their running sums give every partition's offset, and a
window inside each partition adds the rest.  No task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortvox.sources.workspace import Workspace


def prefix_sums(df: DataFrame, order: list[str], values: list[str], ws: Workspace, group: list[str] = ()) -> DataFrame:
    """Adds ``<value>_before`` for each value column and ``rows_before``.

    Sums run over the rows that precede in ``order`` within ``group`` (columns
    that must lead ``order``).  Rows that tie in the whole order are taken in
    any order.  Values are BIGINT and not null.
    """
    group = list(group)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order])
    t = ws.table(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    sums = [F.sum(v).alias(f"__{v}") for v in values] + [F.count("*").alias("__rows")]
    totals = t.groupBy("__part", *group).agg(*sums)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = [*values, "rows"]
    offsets = totals.select(
        F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group],
        *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}_offset") for v in names],
    )
    on = F.col("__part") == F.col("__p")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    inner = Window.partitionBy("__part", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__one", F.lit(1))
    local = t.select("*", *[F.coalesce(F.sum(F.col(v if v != "rows" else "__one")).over(inner), F.lit(0)).alias(f"__{v}_local") for v in names])
    out = local.join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"__{v}_offset") + F.col(f"__{v}_local")).cast("long").alias(f"{v}_before") for v in names])
