"""Quality of segmentations and images, artifacts and limitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortvox.functions.text import present
from cohortvox.operators import components as C, grid as G
from cohortvox.operators.masks import BROADCAST_CASES, brain_mask, case_percentiles, region, touches_border
from cohortvox.sources.voxels import SEQUENCES, voxel_cm3
from cohortvox.sources.workspace import Workspace

NAMES = {"t1": "T1", "t1ce": "T1ce", "t2": "T2", "flair": "FLAIR"}


#: Rules of a segmentation whose texts are issues; the others are warnings.
ISSUES = (0, 3)


def segmentation_quality(df: DataFrame, ws: Workspace, components: DataFrame | None = None) -> DataFrame:
    """A score of 100 less deductions, with its grade and warnings.

    ``components`` are the tumour's (case_id, component) rows where they are known already.
    """
    if components is None:
        n = C.count_parts(df, region("wt"), ws)
    else:
        n = components.select("case_id", "component").distinct().groupBy("case_id").agg(F.count("*").alias("parts"))
    a = df.groupBy("case_id").agg(
        *[F.count_if(region(r)).alias(r) for r in ("wt", "tc", "et")], F.count_if(region("et") & ~region("tc")).alias("stray"),
        F.max(region("wt") & touches_border()).alias("boundary"), F.first(voxel_cm3()).alias("cm3"),
    )
    a = a.join(n, "case_id", "left").join(C.hole_fraction(df, region("wt"), ws), "case_id").fillna(0, ["parts"])
    v, wt = F.col("wt") * F.col("cm3"), F.col("wt")
    rules = [  # condition, points, text
        (wt == 0, 50, "No tumor segmentation detected"),
        ((wt > 0) & (v < 0.5), 10, F.format_string("Very small tumor volume (%.2f cm³) - may be artifact", v)),
        (v > 300, 10, F.format_string("Very large tumor volume (%.0f cm³) - verify boundaries", v)),
        (F.col("tc") > 1.01 * wt, 20, "Tumor core volume exceeds whole tumor - label inconsistency"),
        (F.col("parts") > 5, 5, F.format_string("Multiple disconnected components (%d) - possible over-segmentation", F.col("parts"))),
        (F.col("stray") > 0.05 * F.col("et"), 5, "Some enhancing tumor voxels outside tumor core boundary"),
        ((wt > 0) & (F.col("hole_fraction") > 0.1), 5, F.format_string("Segmentation has internal holes (%.0f%% of volume)", F.col("hole_fraction") * 100)),
        (F.col("boundary"), 10, "Tumor extends to image boundary - may be truncated"),
    ]
    score = F.lit(100) - sum(F.when(c, p).otherwise(0) for c, p, _ in rules)
    texts = lambda *kinds: present(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for k, (c, _, t) in enumerate(rules) if (k in ISSUES) in kinds])
    q = F.col("score")
    return a.withColumn("score", score).select(
        "case_id", "score", F.when(wt == 0, "Poor").when(q >= 90, "Excellent").when(q >= 75, "Good").when(q >= 60, "Fair").when(q >= 40, "Poor").otherwise("Unacceptable").alias("grade"),
        F.col("parts").cast("long").alias("parts"), "hole_fraction", F.col("boundary").alias("at_boundary"),
        F.concat_ws("; ", texts(True, False)).alias("findings"), F.concat_ws("; ", texts(True)).alias("issues"), F.concat_ws("; ", texts(False)).alias("warnings"),
    )


def image_quality(df: DataFrame) -> DataFrame:
    """Per case and sequence: noise, missing data, outliers and a grade (brain taken from T1)."""
    b = brain_mask(df)
    long = b.select("case_id", "brain", F.explode(F.array(*[F.struct(F.lit(NAMES[s]).alias("sequence"), F.col(s).cast("double").alias("v")) for s in SEQUENCES])).alias("s"))
    long = long.select("case_id", "brain", "s.sequence", "s.v")
    v, brain = F.col("v"), F.col("brain")
    inside = F.when(brain, v)
    q = long.groupBy("case_id", "sequence").agg(
        F.percentile(inside, F.array(*[F.lit(p) for p in (0.01, 0.25, 0.75, 0.99)])).alias("q"), F.percentile(F.when(v > 0, v), F.lit(0.1)).alias("p10"),
    )
    few = df.select("case_id").distinct().count() <= BROADCAST_CASES
    j = long.join(F.broadcast(q) if few else q, ["case_id", "sequence"])
    iqr = F.col("q")[2] - F.col("q")[1]
    back = ~brain & (v > 0) & (v < F.col("p10"))
    a = j.groupBy("case_id", "sequence").agg(
        F.count(inside).alias("n"), F.avg(inside).alias("mean"), F.stddev_pop(inside).alias("std"), F.count_if(back).alias("nb"), F.stddev_pop(F.when(back, v)).alias("bs"),
        F.count_if(brain & (v == 0)).alias("zeros"), F.count_if(brain & ((v > F.col("q")[3] + 3 * iqr) | (v < F.col("q")[0] - 3 * iqr))).alias("out"),
    )
    noise = F.when(F.col("nb") > 100, F.col("bs")).otherwise(F.col("std"))
    a = a.withColumn("snr", F.when(noise > 0, F.col("mean") / noise).otherwise(0.0)).withColumn("zero_fraction", F.coalesce(F.col("zeros") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)))
    a = a.withColumn("outlier_fraction", F.coalesce(F.col("out") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)))
    issues = (F.col("zero_fraction") > 0.01).cast("int") + (F.col("outlier_fraction") > 0.01).cast("int")
    s = F.col("snr")
    grade = F.when(F.col("n") == 0, "Poor").when((s > 20) & (issues == 0), "Excellent").when((s > 10) & (issues <= 1), "Good").when(s > 5, "Fair").otherwise("Poor")
    return a.select("case_id", "sequence", "snr", "zero_fraction", "outlier_fraction", "mean", "std", issues.alias("issues"), grade.alias("quality"))


def overall_quality(per_sequence: DataFrame) -> DataFrame:
    q = per_sequence.groupBy("case_id").agg(F.collect_list("quality").alias("q"), F.max(F.when(F.col("sequence") == "T2", F.col("snr"))).alias("t2_snr"))
    return q.select(
        "case_id", "t2_snr", F.when(F.forall("q", lambda v: v == "Excellent"), "Excellent").when(F.forall("q", lambda v: v.isin("Excellent", "Good")), "Good")
        .when(F.exists("q", lambda v: v == "Poor"), "Poor").otherwise("Fair").alias("overall"),
    )


def edge_signal(margin: int = 5, value: str = "t1") -> list[Column]:
    """Aggregates: whether there is signal within ``margin`` cells of each end of x and y."""
    low = [(f"{a}_min", F.col(a) < margin) for a in "xy"]
    high = [(f"{a}_max", F.col(a) >= F.col(f"n{a}") - margin) for a in "xy"]
    return [F.coalesce(F.max(c & (F.col(value) > 0)), F.lit(False)).alias(n) for pair in zip(low, high, strict=True) for n, c in pair]


def artifacts(df: DataFrame) -> DataFrame:
    """Bias field, ghosting, susceptibility, wrap-around and ringing."""
    brain, t1 = F.col("brain"), F.col("t1")
    b = case_percentiles(brain_mask(df), {}, {f"__{a}": F.avg(F.when(brain, F.col(a))) for a in "xyz"})
    r = F.sqrt(sum((F.col(a) - F.col(f"__{a}")) ** 2 for a in "xyz"))
    b = case_percentiles(b.withColumn("__r", r), {}, {"__far": F.max(F.when(brain, F.col("__r")))})
    b = G.known(b, {"depth": ("wt_depth", "l1_depth", region("wt"))})
    b = b.withColumn("grad", F.col("t1_sobel")) if "t1_sobel" in b.columns else G.sobel(b, "t1", "grad")
    inner, outer = brain & (F.col("__r") < 0.3 * F.col("__far")), brain & (F.col("__r") > 0.7 * F.col("__far"))
    rim = region("wt") & (F.col("depth") <= 2)
    back = {s: ~brain & (F.col(s) > 0) for s in SEQUENCES}
    zero = brain & (t1 == 0)
    a = b.groupBy("case_id").agg(
        F.count_if(inner).alias("ni"), F.count_if(outer).alias("no"), (F.avg(F.when(outer, t1)) / F.avg(F.when(inner, t1))).alias("bias"),
        *[F.count_if(back[s]).alias(f"nb_{s}") for s in SEQUENCES], *[(F.stddev_pop(F.when(back[s], F.col(s))) / F.avg(F.when(back[s], F.col(s)))).alias(f"cv_{s}") for s in SEQUENCES],
        F.count_if(zero).alias("nz_"), (F.avg(F.when(zero, F.col("z"))) < 0.5 * F.avg(F.when(brain, F.col("z")))).alias("low"),
        *edge_signal(),
        F.count_if(rim).alias("nr"), (F.stddev_pop(F.when(rim, F.col("grad"))) / F.avg(F.when(rim, F.col("grad")))).alias("ring"),
    )
    ghost = [F.when((F.col(f"nb_{s}") > 1000) & (F.col(f"cv_{s}") > 0.5), F.lit(NAMES[s])) for s in SEQUENCES]
    edges = sum(F.col(f"{a}_{e}").cast("int") for a in "xy" for e in ("min", "max"))
    known = (F.col("ni") > 100) & (F.col("no") > 100)
    found = present(
        F.when(known & ((F.col("bias") < 0.7) | (F.col("bias") > 1.4)), F.lit("Intensity inhomogeneity")),
        F.when(F.size(present(*ghost)) > 0, F.lit("Possible motion artifact")),
        F.when((F.col("nz_") > 100) & F.col("low"), F.lit("Susceptibility artifact")),
        F.when(edges >= 3, F.lit("Possible wrap-around")),
        F.when((F.col("nr") > 100) & (F.col("ring") > 1.5), F.lit("Possible Gibbs ringing")),
    )
    n = F.size("found")
    return a.withColumn("found", found).select(
        "case_id", F.concat_ws(", ", "found").alias("artifacts"), F.when(n == 0, "None").when(n <= 2, "Mild").otherwise("Moderate to Severe").alias("severity"),
        F.when(known, F.col("bias")).alias("bias_ratio"), F.concat_ws(",", present(*ghost)).alias("ghosting"), edges.alias("edges"), F.when(F.col("nr") > 100, F.col("ring")).alias("edge_cv"),
        F.when(n > 1, "Review recommended").otherwise("Minimal impact expected").alias("impact"),
    )


#: Confidence of each kind of measurement.
CONFIDENCE = {
    "volume_measurements": "High", "enhancement_analysis": "High", "midline_shift": "Moderate", "margin_analysis": "Moderate",
    "anatomical_localization": "Moderate", "multiplicity": "High",
}


def confidence(cases: DataFrame) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return cases.select("case_id").distinct().select("case_id", F.explode(m).alias("measurement", "confidence"))


def caveats(segmentation: DataFrame, overall: DataFrame, enhancing: DataFrame) -> DataFrame:
    """Caveats that follow from the measurements; ``enhancing`` has the case's et count."""
    j = enhancing.join(segmentation, "case_id").join(overall, "case_id")
    texts = present(
        F.when(F.col("et") == 0, F.lit("Non-enhancing pattern: Can be seen with lower-grade glioma, treatment effect, or other pathology; clinical and histopathological correlation required")),
        F.when(F.col("at_boundary"), F.lit("Tumor at image boundary: Volume may be underestimated")),
        F.when(F.col("t2_snr") < 6, F.format_string("Low T2 SNR (%.1f): Necrosis fraction and cystic/solid classification less reliable", F.col("t2_snr"))),
        F.when(F.col("overall").isin("Fair", "Poor"), F.lit("Suboptimal image quality may affect measurement accuracy")),
        F.lit("Model optimized for adult gliomas; performance may vary for other tumor types"),
        F.lit("Peritumoral edema vs infiltrating tumor cannot be distinguished on conventional MRI"),
    )
    return j.select("case_id", texts.alias("caveats"))
