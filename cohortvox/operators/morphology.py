"""Shape, border, margin, cystic share and necrosis of the tumour."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cohortvox.operators import grid as G
from cohortvox.operators.masks import case_percentiles, region
from cohortvox.sources.voxels import voxel_cm3


def eigenvalues(a: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Eigenvalues, largest first, of the symmetric matrix with entries xx, yy, zz, xy, xz, yz (trigonometric form)."""
    q = (a["xx"] + a["yy"] + a["zz"]) / 3
    dev = {k: a[k] - q for k in ("xx", "yy", "zz")}
    off = a["xy"] ** 2 + a["xz"] ** 2 + a["yz"] ** 2
    p = F.sqrt((dev["xx"] ** 2 + dev["yy"] ** 2 + dev["zz"] ** 2 + 2 * off) / 6)
    det = (
        dev["xx"] * (dev["yy"] * dev["zz"] - a["yz"] ** 2) - a["xy"] * (a["xy"] * dev["zz"] - a["yz"] * a["xz"]) + a["xz"] * (a["xy"] * a["yz"] - dev["yy"] * a["xz"])
    )
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det / (2 * F.when(p > 0, p) ** 3), F.lit(0.0))))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return first, 3 * q - first - last, last


def shape(df: DataFrame) -> DataFrame:
    """Volume, surface, sphericity, compactness, elongation, axes and classes."""
    d = G.known(df, {"depth": ("wt_depth", "l1_depth", region("wt"))}).where(region("wt"))
    p = {a: F.col(a) * F.col(f"d{a}") for a in "xyz"}
    t = d.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("depth") <= 1).alias("surface"), F.first(voxel_cm3()).alias("cm3"),
        F.first((F.col("dx") * F.col("dy") + F.col("dy") * F.col("dz") + F.col("dx") * F.col("dz")) / 3).alias("face"),
        *[F.var_samp(p[a]).alias(a + a) for a in "xyz"], *[F.covar_samp(p[a], p[b]).alias(a + b) for a, b in ("xy", "xz", "yz")],
    )
    e = eigenvalues({k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")})
    small = F.col("n") < 10
    mm3, area = F.col("n") * F.col("cm3") * 1000, F.col("surface") * F.col("face")
    sphere = 4 * math.pi * F.pow(3 * mm3 / (4 * math.pi), F.lit(2 / 3))
    t = t.select(
        "case_id", (F.col("n") * F.col("cm3")).alias("volume_cm3"), area.alias("surface_mm2"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sphere / area)).alias("sphericity"),
        F.least(F.lit(1.0), 36 * math.pi * mm3**2 / area**3).alias("compactness"),
        F.when(small, 1.0).when(e[2] > 0, F.sqrt(e[0] / e[2])).otherwise(1.0).alias("elongation"),
        *[F.when(small, 1.0).otherwise(2 * F.sqrt(F.greatest(v, F.lit(0.0)))).alias(f"axis{k}_mm") for k, v in enumerate(e, 1)],
    )
    out = df.select("case_id").distinct().join(t, "case_id", "left").fillna(0.0, ["volume_cm3", "surface_mm2", "sphericity", "compactness", "axis1_mm", "axis2_mm", "axis3_mm"]).fillna(1.0, ["elongation"])
    s, k, some = F.col("sphericity"), F.col("elongation"), F.col("volume_cm3") > 0
    return out.withColumn("shape_class", F.when(~some, None).when(s > 0.8, "Spherical/round").when(s > 0.6, "Ovoid").when(s > 0.4, "Irregular").otherwise("Highly irregular/complex")).withColumn(
        "elongation_class", F.when(~some, None).when(k > 2.5, "Elongated").when(k > 1.5, "Mildly elongated").otherwise("Roughly isotropic")
    )


def border(df: DataFrame) -> DataFrame:
    """Variation of the signed distance's gradient over the surface."""
    d = G.known(df, {"depth": ("wt_depth", "l1_depth", region("wt")), "grad": ("wt_slope", "signed_slope", region("wt"))})
    on = region("wt") & (F.col("depth") <= 1)
    t = d.groupBy("case_id").agg(F.count_if(region("wt")).alias("n"), F.count_if(on).alias("surface"), F.avg(F.when(on, F.col("grad"))).alias("m"), F.stddev_pop(F.when(on, F.col("grad"))).alias("s"))
    score = F.when(F.col("n") == 0, 0.0).when(F.col("surface") < 10, 1.0).when(F.col("s") > 0, 1 / (1 + F.col("s") / F.col("m"))).otherwise(1.0)
    r = F.col("regularity")
    return t.withColumn("regularity", score).select(
        "case_id", "surface", "regularity",
        F.when(F.col("n") == 0, "No tumor").when(F.col("surface") < 10, "Too small to assess").when(r > 0.7, "Smooth contour").when(r > 0.5, "Mildly lobulated").when(r > 0.3, "Lobulated").otherwise("Highly irregular").alias("classification"),
    )


def margin(df: DataFrame) -> DataFrame:
    """How sharply T1ce changes from the tumour to the tissue around it."""
    d = G.known(df, {"depth": ("wt_depth", "l1_depth", region("wt")), "near": ("wt_near", "l1", region("wt"))})
    v = F.col("t1ce")
    at = lambda m: F.when(m, v)
    band, inner, outer = F.col("near").between(1, 5), region("wt") & (F.col("depth") <= 1), F.col("near") == 1
    t = d.groupBy("case_id").agg(
        F.count_if(region("wt")).alias("n"), F.count_if(band).alias("nb"), F.avg(at(region("wt"))).alias("tm"), F.avg(at(band)).alias("pm"),
        F.avg(at(inner)).alias("im"), F.avg(at(outer)).alias("om"), F.stddev_pop(at(inner)).alias("isd"), F.stddev_pop(at(outer)).alias("osd"),
    )
    contrast = F.when(F.col("pm") > 0, F.abs(F.col("tm") - F.col("pm")) / F.col("pm")).otherwise(0.0)
    step = F.coalesce(F.abs(F.col("im") - F.col("om")) / (F.col("isd") + F.col("osd") + 1e-6), F.lit(0.0))
    s = F.col("sharpness")
    none, bare = F.col("n") == 0, F.col("nb") == 0
    return t.withColumn("sharpness", F.when(none, 0.0).when(bare, 0.5).otherwise(F.least(F.lit(1.0), (contrast + step) / 2))).select(
        "case_id", "sharpness", F.when(~none & ~bare, contrast).alias("contrast"), F.when(~none & ~bare, step).alias("border_gradient"),
        F.when(none, "No tumor").when(bare, "Could not assess").when(s > 0.6, "Sharp transition").when(s > 0.4, "Moderate transition").when(s > 0.2, "Gradual transition").otherwise("Infiltrative transition").alias("classification"),
    )


def cystic(df: DataFrame) -> DataFrame:
    """Share of the tumour that follows the signal of fluid."""
    t = case_percentiles(df, {f"__{s}": (F.col(s), F.col(s) > 0, p) for s, p in (("t1", 10), ("t2", 85), ("flair", 20))})
    fluid = (F.col("t1") < 1.5 * F.col("__t1")) & (F.col("t2") > 0.8 * F.col("__t2")) & (F.col("flair") < 2 * F.col("__flair"))
    n = region("ncr")
    a = t.groupBy("case_id").agg(
        F.count_if(region("wt")).alias("wt"), F.count_if(n).alias("ncr"), F.count_if(n & fluid).alias("fluid"), F.first(voxel_cm3()).alias("cm3"),
        F.avg(F.when(n, F.col("t2"))).alias("m2"), F.stddev_pop(F.when(n, F.col("t2"))).alias("s2"), F.avg(F.when(n, F.col("flair"))).alias("mf"),
    )
    cv = F.when(F.col("m2") > 0, F.col("s2") / F.col("m2")).otherwise(0.0)
    fr = F.when(F.col("m2") > 0, F.col("mf") / F.col("m2")).otherwise(1.0)
    a = a.withColumn("cystic_percent", F.when(F.col("wt") > 0, 100 * F.col("fluid") / F.col("wt")).otherwise(0.0)).withColumn("t2_cv", cv)
    p, none = F.col("cystic_percent"), F.col("wt") == 0
    return a.select(
        "case_id", (F.col("fluid") * F.col("cm3")).alias("cystic_cm3"), "cystic_percent", F.when(none, 0.0).otherwise(100 - p).alias("solid_percent"),
        F.when(none, "No tumor").when(p > 70, "Predominantly cystic").when(p > 40, "Cystic with solid component").when(p > 15, "Solid with cystic component")
        .when((F.col("ncr") > 0) & (F.col("t2_cv") > 0.3), "Solid with necrosis").when(F.col("ncr") > 0, "Solid with possible cyst").otherwise("Solid").alias("classification"),
        F.when(none, None).when(F.col("t2_cv") < 0.2, "Homogeneous").when(F.col("t2_cv") < 0.4, "Mildly heterogeneous").otherwise("Heterogeneous").alias("t2_homogeneity"),
        F.when(none, None).when(fr < 0.7, "Present (suggests true cyst)").otherwise("Absent (suggests necrosis/protein)").alias("flair_suppression"),
    )


def necrosis(df: DataFrame) -> DataFrame:
    """Share, pattern and place of the necrotic core."""
    a = df.groupBy("case_id").agg(
        *[F.count_if(region(r)).alias(r) for r in ("ncr", "tc", "wt")], F.first(voxel_cm3()).alias("cm3"), *[F.first(f"d{k}").alias(f"d{k}") for k in "xyz"],
        *[F.avg(F.when(region(r), F.col(k))).alias(f"{r}_{k}") for r in ("ncr", "tc") for k in "xyz"],
    )
    dist = F.sqrt(sum(((F.col(f"ncr_{k}") - F.col(f"tc_{k}")) * F.col(f"d{k}")) ** 2 for k in "xyz"))
    radius = F.cbrt(3 * F.col("tc") * F.col("cm3") * 1000 / (4 * math.pi))
    some = (F.col("ncr") > 0) & (F.col("wt") > 0)
    p = F.when(some, 100 * F.col("ncr") / F.col("wt")).otherwise(0.0)
    return a.withColumn("percent", p).select(
        "case_id", some.alias("present"), (F.col("ncr") * F.col("cm3")).alias("necrosis_cm3"), "percent",
        F.when(F.col("wt") == 0, "No tumor").when(~some, "No necrosis").when(F.col("percent") > 50, "Extensive necrosis").when(F.col("percent") > 25, "Moderate necrosis")
        .when(F.col("percent") > 10, "Focal necrosis").otherwise("Minimal necrosis").alias("pattern"),
        F.when(~some, None).when(dist < 0.3 * radius, "Central").when(dist < 0.6 * radius, "Eccentric").otherwise("Peripheral").alias("location"),
    )
