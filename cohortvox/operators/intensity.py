"""Masked intensity statistics, volumes and signal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortvox.operators.masks import case_percentiles, region, region_names
from cohortvox.sources.voxels import SEQUENCES, voxel_cm3

SIGNAL_REGIONS = {"ncr": 0, "ed": 1, "et": 2}


def stats(v: Column) -> list[Column]:
    """Mean, population deviation, range, quartiles and count; null but the count when empty."""
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        q[1].alias("median"), q[0].alias("q25"), q[2].alias("q75"), F.count(v).alias("count"),
    ]


def region_stats(df: DataFrame) -> DataFrame:
    """Statistics per (case, region, sequence) from one scan: voxels are exploded over their regions and sequences."""
    seqs = F.array(*[F.struct(F.lit(s).alias("sequence"), F.col(s).cast("double").alias("v")) for s in SEQUENCES])
    long = df.where("seg > 0").select("case_id", F.explode(region_names()).alias("region"), seqs.alias("s"))
    return long.select("case_id", "region", F.explode("s").alias("s")).select("case_id", "region", "s.sequence", "s.v").groupBy("case_id", "region", "sequence").agg(*stats(F.col("v")))


def volumes_cm3(df: DataFrame, regions: tuple[str, ...] = ("wt", "tc", "et", "ncr", "ed")) -> DataFrame:
    """Region volumes of each case."""
    cm3 = F.first(voxel_cm3())
    return df.groupBy("case_id").agg(*[(F.count_if(region(r)) * cm3).alias(f"{r}_cm3") for r in regions])


def label_volumes(df: DataFrame, seg: str = "seg") -> DataFrame:
    """Voxels and volume of each label but 0."""
    return df.where(F.col(seg) > 0).groupBy("case_id", F.col(seg).alias("label")).agg(F.count("*").alias("voxels"), (F.count("*") * F.first(voxel_cm3())).alias("cm3"))


def extent(df: DataFrame, mask: Column) -> DataFrame:
    """Centroid and bounding box (size counts both ends) of a mask; null for an empty one."""
    aggs = []
    for a in "xyz":
        v = F.when(mask, F.col(a))
        aggs += [F.avg(v).alias(f"c{a}"), F.min(v).alias(f"{a}_min"), F.max(v).alias(f"{a}_max"), (F.max(v) - F.min(v) + 1).alias(f"{a}_size")]
    return df.groupBy("case_id").agg(*aggs)


def normal_reference(df: DataFrame) -> DataFrame:
    """Per case the mean of each sequence over untouched brain (its own 5th percentile), and T1's voxels."""
    t = case_percentiles(df, {f"__{s}": (F.col(s), F.col(s) > 0, 5) for s in SEQUENCES})
    m = {s: (F.col(s) > F.col(f"__{s}")) & (F.col("seg") == 0) for s in SEQUENCES}
    return t.groupBy("case_id").agg(*[F.avg(F.when(m[s], F.col(s))).alias(f"normal_{s}") for s in SEQUENCES], F.count_if(m["t1"]).alias("voxel_count"))


def signal_label(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.6, "markedly hypointense").when(ratio < 0.85, "hypointense").when(ratio < 1.15, "isointense")
        .when(ratio < 1.5, "hyperintense").otherwise("markedly hyperintense")
    )


def region_signals(df: DataFrame) -> DataFrame:
    """Per case and region (ncr, ed, et): means, ratios to normal brain, labels and their summary."""
    s = region_stats(df).where(F.col("region").isin(*SIGNAL_REGIONS))
    wide = s.groupBy("case_id", "region").agg(
        *[F.max(F.when(F.col("sequence") == q, F.col("mean"))).alias(f"{q}_mean") for q in SEQUENCES],
        F.max(F.when(F.col("sequence") == "t1ce", F.col("std"))).alias("t1ce_std"), F.max("count").alias("voxels"),
    )
    j = wide.join(normal_reference(df), "case_id")
    for q in SEQUENCES:
        ratio = F.when(F.coalesce(F.col(f"normal_{q}"), F.lit(0.0)) > 0, F.col(f"{q}_mean") / F.col(f"normal_{q}")).otherwise(1.0)
        j = j.withColumn(f"{q}_label", signal_label(ratio)).withColumn(f"{q}_ratio", F.round(ratio, 3))  # labels before rounding
    j = j.withColumn("enhancement_ratio", F.when(F.col("t1_mean") > 0, F.round(F.col("t1ce_mean") / F.col("t1_mean"), 3)).otherwise(1.0))
    summary = F.concat_ws(", ", *[F.concat(F.lit(f"{n} "), F.col(f"{q}_label")) for q, n in (("t1", "T1"), ("t2", "T2"), ("flair", "FLAIR"), ("t1ce", "T1ce"))])
    return j.withColumn("signal_summary", summary)


def t2_flair_mismatch(signals: DataFrame) -> DataFrame:
    """Per case, the first region in the order ncr, ed, et with a bright T2 and a suppressed FLAIR."""
    hit = (F.col("t2_ratio") > 1.3) & (F.col("flair_ratio") < 0.7 * F.col("t2_ratio"))
    order = F.create_map(*[F.lit(x) for kv in SIGNAL_REGIONS.items() for x in kv])[F.col("region")]
    return signals.groupBy("case_id").agg(F.max(hit).alias("mismatch"), F.min_by(F.when(hit, F.col("region")), F.when(hit, order)).alias("region"))


def enhancement(signals: DataFrame, ring: DataFrame) -> DataFrame:
    """Per case: pattern, heterogeneity and strength; ``ring`` has et, ncr and rim voxel counts."""
    et = signals.where("region = 'et'").select("case_id", "enhancement_ratio", (F.col("t1ce_std") / F.when(F.col("t1ce_mean") > 0, F.col("t1ce_mean"))).alias("cv"))
    j = ring.join(et, "case_id", "left")
    present, cv, r = F.col("et") > 0, F.col("cv"), F.col("enhancement_ratio")
    return j.select(
        "case_id", present.alias("present"),
        F.when(~present, "Non-enhancing").when((F.col("ncr") > 0) & (F.col("rim") > 0.3 * F.col("et")), "Ring-enhancing").otherwise("Solid/nodular enhancing").alias("pattern"),
        F.when(~present, "Not applicable").when(cv > 0.35, "Markedly heterogeneous").when(cv > 0.25, "Heterogeneous").when(cv > 0.15, "Mildly heterogeneous").when(cv.isNotNull(), "Homogeneous").alias("heterogeneity"),
        F.when(~present, None).when(r > 2, "Marked enhancement").when(r > 1.5, "Strong enhancement").when(r > 1.2, "Moderate enhancement")
        .when(r > 1.05, "Mild enhancement").otherwise("Minimal/equivocal enhancement").alias("strength"),
    )
