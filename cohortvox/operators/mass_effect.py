"""Midline shift, ventricular compression, sulcal effacement, herniation score and location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortvox.functions.text import present
from cohortvox.operators import grid as G
from cohortvox.operators.masks import brain_mask, csf_candidate, lobes, region
from cohortvox.sources.voxels import voxel_cm3

#: Below this shift no direction is reported.
NOISE_MM = 1.0


def midline_shift(df: DataFrame) -> DataFrame:
    """Shift of the two brain halves' centres against the middle of the brain's width."""
    b = brain_mask(df)
    wide = b.groupBy("case_id").agg(
        F.min(F.when(F.col("brain"), F.col("x"))).alias("lo"), F.max(F.when(F.col("brain"), F.col("x"))).alias("hi"),
        F.avg(F.when(region("wt"), F.col("x"))).alias("tumor_x"), F.first("dx").alias("sx"),
    )
    mid = (F.col("lo") + F.col("hi")) / 2
    j = b.where("brain").select("case_id", "x").join(wide, "case_id").withColumn("mid", mid)
    halves = j.groupBy("case_id").agg(F.avg(F.when(F.col("x") < F.floor("mid"), F.col("x"))).alias("l"), F.avg(F.when(F.col("x") >= F.floor("mid"), F.col("x"))).alias("r"))
    j = wide.join(halves, "case_id", "left").withColumn("mid", mid).withColumn("w", (F.col("hi") - F.col("lo")) / 4)
    est = ((F.col("l") - (F.col("mid") - F.col("w"))) + (F.col("r") - (F.col("mid") + F.col("w")))) / 2 * F.col("sx")
    j = j.withColumn("est", F.coalesce(est, F.lit(0.0))).withColumn("mm", F.abs("est"))
    none, lost, mm = F.col("tumor_x").isNull(), F.col("lo").isNull(), F.col("mm")
    left = F.col("tumor_x") < F.col("mid")
    across = F.when((F.col("est") > 0) == left, "Left to right").otherwise("Right to left")
    return j.select(
        "case_id", F.when(none, 0.0).when(~lost, mm).alias("shift_mm"),
        F.when(none, "Not applicable").when(lost, "Unknown").when(mm < NOISE_MM, "Not applicable (below measurement threshold)").otherwise(across).alias("direction"),
        F.when(none | lost, None).when(left, "left").otherwise("right").alias("tumor_hemisphere"),
        F.when(none, "No tumor detected").when(lost, "Could not calculate").when(mm < NOISE_MM, "None").when(mm < 3, "Minimal").when(mm < 5, "Mild").when(mm < 10, "Moderate").otherwise("Severe").alias("severity"),
        (~none & ~lost & (mm >= NOISE_MM)).alias("significant"),
        F.when(~none & ~lost, F.abs(F.col("tumor_x") - F.col("mid")) * F.col("sx")).alias("distance_to_midline_mm"),
    )


def ventricular_compression(df: DataFrame) -> DataFrame:
    """CSF volumes left and right of the grid's middle, and the exact distance from tumour to CSF (times dx)."""
    b = df.withColumn("csf", F.col("candidate")) if "candidate" in df.columns else csf_candidate(brain_mask(df))
    b = G.known(b, {"to_csf": ("candidate_far", "edt", F.col("csf"))})
    left = F.col("x") < F.floor(F.col("nx") / 2)
    a = b.groupBy("case_id").agg(
        (F.count_if(F.col("csf") & left) * F.first(voxel_cm3())).alias("left_cm3"), (F.count_if(F.col("csf") & ~left) * F.first(voxel_cm3())).alias("right_cm3"),
        (F.min(F.when(region("wt"), F.col("to_csf"))) * F.first("dx")).alias("distance_mm"),
    )
    lo, hi = F.col("left_cm3"), F.col("right_cm3")
    a = a.withColumn("asymmetry", F.when(lo + hi > 0, F.abs(lo - hi) / (lo + hi)).otherwise(0.0))
    k = F.col("asymmetry")
    return a.withColumn("compressed_side", F.when(lo < 0.7 * hi, "left").when(hi < 0.7 * lo, "right").otherwise("none")).withColumn(
        "severity", F.when(k > 0.5, "Severe").when(k > 0.3, "Moderate").when(k > 0.15, "Mild").otherwise("None/Minimal")
    )


def sulcal_effacement(df: DataFrame) -> DataFrame:
    """Intensity deviation within ten dilations of the tumour against the rest of the brain."""
    b = G.known(brain_mask(df), {"near": ("wt_near", "l1", region("wt"))})
    rim, far = F.col("brain") & F.col("near").between(1, 10), F.col("brain") & (F.col("near") > 10)
    a = b.groupBy("case_id").agg(
        F.count_if(region("wt")).alias("n"), F.count_if(rim).alias("n_rim"), F.count_if(far).alias("n_far"),
        F.stddev_pop(F.when(rim, F.col("t1"))).alias("rim_std"), F.stddev_pop(F.when(far, F.col("t1"))).alias("far_std"),
    )
    r = F.when(F.col("far_std") > 0, F.col("rim_std") / F.col("far_std")).otherwise(1.0)
    bad, gone = (F.col("n") == 0) | (F.col("n_rim") == 0), F.col("n_far") == 0
    return a.select(
        "case_id", F.when(~bad & ~gone, r).alias("variance_ratio"),
        F.when(F.col("n") == 0, "No tumor detected").when(bad, "Could not analyze").when(gone, "Severe").when(r < 0.6, "Moderate to Severe").when(r < 0.8, "Mild to Moderate").otherwise("None/Minimal").alias("severity"),
        F.when(bad, False).otherwise(gone | (r < 0.8)).alias("effacement"),
    )


def herniation(shift: DataFrame, ventricles: DataFrame, sulci: DataFrame, volume: DataFrame) -> DataFrame:
    """Points for measured displacement, the risk level, its factors and signs."""
    j = (
        shift.select("case_id", F.coalesce("shift_mm", F.lit(0.0)).alias("mm"))
        .join(ventricles.select("case_id", "asymmetry"), "case_id").join(sulci.select("case_id", F.col("severity").alias("sulcal")), "case_id")
        .join(volume.select("case_id", "wt_cm3"), "case_id")
    )
    mm, asym, sulcal = F.col("mm"), F.col("asymmetry"), F.col("sulcal")
    hard = sulcal.isin("Moderate to Severe", "Severe")
    points = (
        F.when(mm >= 10, 4.0).when(mm >= 5, 3.0).when(mm >= 3, 2.0).when(mm >= 1, 1.0).otherwise(0.0)
        + F.when(asym > 0.5, 2.0).when(asym > 0.3, 1.0).when(asym > 0.15, 0.5).otherwise(0.0)
        + F.when(hard, 1.0).when(sulcal == "Mild to Moderate", 0.5).otherwise(0.0)
    )
    shift_word = F.when(mm >= 10, "severe").when(mm >= 5, "moderate").when(mm >= 3, "mild").when(mm >= 1, "minimal")
    asym_word = F.when(asym > 0.5, "severe").when(asym > 0.3, "moderate").when(asym > 0.15, "mild")
    factors = present(
        F.when(shift_word.isNotNull(), F.format_string("Midline shift: %.1fmm (%s)", mm, shift_word)),
        F.when(asym_word.isNotNull(), F.format_string("Ventricular asymmetry: %.2f (%s)", asym, asym_word)),
        F.when(hard | (sulcal == "Mild to Moderate"), F.concat(F.lit("Sulcal effacement: "), sulcal)),
    )
    signs = present(
        F.when(mm >= 10, "Severe midline shift (>10mm) - high subfalcine herniation risk").when(mm >= 5, "Moderate midline shift (5-10mm) - subfalcine herniation possible")
        .when(mm >= 3, "Mild midline shift (3-5mm) - early mass effect"),
        F.when(asym > 0.5, "Severe ventricular asymmetry - significant mass effect"),
    )
    big = F.array(F.format_string("Large tumor (%.1fcm³) without significant mass effect currently", F.col("wt_cm3")), F.lit("Recommend close monitoring for interval mass effect development"))
    signs = F.when(F.size(signs) > 0, signs).when(F.col("wt_cm3") > 50, big).otherwise(F.array(F.lit("No significant herniation risk - no measurable mass effect")))
    p = F.col("score")
    return j.withColumn("score", points).select(
        "case_id", "score", F.when(p >= 5, "High").when(p >= 3, "Moderate").when(p >= 1.5, "Mild").otherwise("Low").alias("risk"),
        F.concat_ws("; ", factors).alias("factors"), F.concat_ws("; ", signs).alias("signs"),
    )


LOBES = ("frontal", "parietal", "temporal", "occipital", "deep_structures")


def location(df: DataFrame) -> DataFrame:
    """Hemisphere, laterality, lobes, depth and gyri of the tumour."""
    box = lobes()
    left = F.col("x") < F.floor(F.col("nx") / 2)
    geo = ("nx", "ny", "nz", "dx", "dy", "dz")
    t = df.groupBy("case_id").agg(
        F.count_if(region("wt")).alias("n"), F.count_if(region("wt") & left).alias("l"),
        *[F.count_if(region("wt") & box[k]).alias(k) for k in LOBES], *[F.avg(F.when(region("wt"), F.col(a))).alias(f"c{a}") for a in "xyz"], *[F.first(g).alias(g) for g in geo],
    )
    n, lo = F.col("n"), F.col("l")
    hi = n - lo
    none = n == 0
    shares = [F.when(F.col(k) > (0.1 if k == "deep_structures" else 0.05) * n, 100 * F.col(k) / n) for k in LOBES]
    entries = F.filter(F.array(*[F.when(s.isNotNull(), F.struct(s.alias("share"), F.lit(-i).alias("order"), F.lit(k).alias("lobe"))) for i, (k, s) in enumerate(zip(LOBES, shares, strict=True))]), lambda e: e.isNotNull())
    dist = F.sqrt(sum(((F.col(f"c{a}") - F.col(f"n{a}") / 2) * F.col(f"d{a}")) ** 2 for a in "xyz"))
    radius = F.least("nx", "ny", "nz") * F.least("dx", "dy", "dz") / 2
    t = t.withColumn("e", entries).withColumn("depth_score", F.when(~none, 1 - dist / radius))
    z, nz = F.col("cz"), F.col("nz")
    has = lambda k: F.exists("e", lambda e: e.lobe == k)
    gyri = present(
        F.when(has("frontal"), F.when(z > 0.7 * nz, "superior frontal gyrus region").when(z > 0.5 * nz, "middle frontal gyrus region").otherwise("inferior frontal gyrus region")),
        F.when(has("parietal"), F.when(z > 0.65 * nz, "superior parietal lobule region").otherwise("inferior parietal lobule region")),
        F.when(has("temporal"), F.when(z > 0.45 * nz, "superior temporal gyrus region").when(z > 0.3 * nz, "middle temporal gyrus region").otherwise("inferior temporal gyrus region")),
        F.when(has("occipital"), F.lit("occipital cortex region")),
    )
    names = F.transform("e", lambda e: F.when(e.lobe == "deep_structures", "deep structures").otherwise(e.lobe))
    best = F.array_max("e")
    d = F.col("depth_score")
    return t.select(
        "case_id",
        F.when(none, "None").when(lo > 0.9 * n, "left").when(hi > 0.9 * n, "right").when(lo > 0.6 * n, "left-predominant").when(hi > 0.6 * n, "right-predominant").otherwise("bilateral").alias("hemisphere"),
        F.when(none, "N/A").when(lo > 0.9 * n, "Unilateral (left hemisphere)").when(hi > 0.9 * n, "Unilateral (right hemisphere)").when(lo > 0.6 * n, "Bilateral, left-predominant")
        .when(hi > 0.6 * n, "Bilateral, right-predominant").otherwise("Bilateral (crosses midline)").alias("laterality"),
        F.when(none, "").when(F.size("e") == 0, "location indeterminate").otherwise(F.concat_ws(",", names)).alias("lobes"),
        F.when(none, "None").otherwise(F.coalesce(best["lobe"], F.lit("indeterminate"))).alias("primary_lobe"),
        F.coalesce(best["share"], F.lit(0.0)).alias("primary_percent"),
        F.when(none, "No tumor detected").when(d > 0.7, "Deep (periventricular/central)").when(d > 0.4, "Subcortical").otherwise("Cortical/Superficial").alias("depth"),
        d.alias("depth_score"),
        F.when(none, "").when(F.size(gyri) == 0, "gyral localization not determined").otherwise(F.concat_ws(",", gyri)).alias("gyri"),
    )
