"""Ventricles, parenchyma and vessels outside the tumour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortvox.operators import components as C, grid as G
from cohortvox.operators.masks import brain_mask, case_percentiles, csf_mask, flow_voids, region
from cohortvox.sources.voxels import voxel_cm3
from cohortvox.sources.workspace import Workspace

#: What ventricles and the operators on them read of a grid.
READ = ("case_id", "x", "y", "z", "nx", "ny", "nz", "dx", "dy", "dz", "seg", "t1", "t2", "flair", "brain", "csf", "fluid", "wt_near", "brain_depth")


def _read(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c in READ])


def ventricles(df: DataFrame, ws: Workspace, least: int = 1000) -> DataFrame:
    """``df`` with brain, csf and ``ventricle``: large, central 18-components of the opened fluid mask."""
    m = df if "fluid" in df.columns else ws.table(G.opened(csf_mask(brain_mask(df)), F.col("csf"), "fluid"), "fluid")
    lab = ws.table(C.label(m, F.col("fluid"), ws, 18), "labelled")
    geo = m.select("case_id", "nx").distinct()
    keep = C.central_large(C.component_stats(lab), geo, least).select("case_id", "component")
    v = lab.join(keep, ["case_id", "component"], "left_semi").select("case_id", "x", "y", "z", F.lit(True).alias("ventricle"))
    return m.join(v, ["case_id", "x", "y", "z"], "left").withColumn("ventricle", F.coalesce("ventricle", F.lit(False)))


def ventricular_system(df: DataFrame, ws: Workspace, least: int = 1000, found: DataFrame | None = None) -> DataFrame:
    """Volumes, symmetry, Evans estimate, hydrocephalus and obstruction; ``found`` is the output of ``ventricles``."""
    t = G.known(ventricles(_read(df), ws, least) if found is None else found, {"near": ("wt_near", "l1", region("wt"))})
    t = t if "wt_near" in t.columns else ws.table(t, "near")
    v, left = F.col("ventricle"), F.col("x") < F.floor(F.col("nx") / 2)
    a = t.groupBy("case_id").agg(
        F.count_if(v & left).alias("nl"), F.count_if(v & ~left).alias("nr"), F.count_if(F.col("brain") & ~region("wt")).alias("nb"), F.count_if(v & (F.col("near") <= 5)).alias("close"),
        F.first(voxel_cm3()).alias("cm3"), F.first("nx").alias("nx"), F.percentile(F.when(v, F.col("y")), F.lit(0.75)).alias("front"),
    )
    width = t.where(v).join(a.select("case_id", "front"), "case_id").where("y >= floor(front)").groupBy("case_id", "y", "z").count().groupBy("case_id").agg(F.max("count").alias("width"))
    j = a.join(width, "case_id", "left")
    n = F.col("nl") + F.col("nr")
    vbr = F.when(F.col("nb") > 0, 100 * n / F.col("nb")).otherwise(0.0)
    j = j.withColumn("vbr", vbr).withColumn("evans", F.coalesce(F.col("width") / F.col("nx"), F.lit(0.0)))
    j = j.withColumn("asymmetry", F.when(n > 0, F.abs(F.col("nl") - F.col("nr")) / n).otherwise(0.0)).withColumn("obstruction", F.when(n > 0, F.col("close") / n).otherwise(0.0))
    r, side = F.col("vbr"), F.when(F.col("nl") > F.col("nr"), "left").when(F.col("nr") > F.col("nl"), "right").otherwise("symmetric")
    full = (F.col("evans") > 0.3) & (r > 5)
    return j.select(
        "case_id", (n * F.col("cm3")).alias("total_cm3"), (F.col("nl") * F.col("cm3")).alias("left_cm3"), (F.col("nr") * F.col("cm3")).alias("right_cm3"), "vbr", "asymmetry", "evans", "obstruction",
        F.when(r < 2, "Normal").when(r < 4, "Mildly prominent").when(r < 6, "Moderately dilated").otherwise("Markedly dilated").alias("size"),
        F.when(full, "Communicating hydrocephalus suggested").when(r > 7, "Ventriculomegaly noted").otherwise("No hydrocephalus").alias("hydrocephalus"),
        F.when(F.col("asymmetry") < 0.15, "Symmetric").otherwise(F.format_string("Asymmetric (%s larger)", side)).alias("symmetry"),
    )


def parenchyma(df: DataFrame, ws: Workspace, least: int = 1000, found: DataFrame | None = None) -> DataFrame:
    """Periventricular signal and grey-white differentiation by depth in the brain; ``found`` as above."""
    t = ventricles(_read(df), ws, least) if found is None else found
    t = t.select(*[c for c in ("case_id", "x", "y", "z", "nx", "ny", "nz", "dx", "dy", "dz", "seg", "t1", "flair", "brain", "ventricle", "brain_depth") if c in t.columns])
    t = ws.table(G.known(t, {"near": ("ventricle_near", "l1", F.col("ventricle")), "depth": ("brain_depth", "edt", ~F.col("brain"))}), "depth")
    brain, normal = F.col("brain"), F.col("brain") & (F.col("seg") == 0)
    t = case_percentiles(t, {"__deep": (F.col("depth"), brain, 60), "__rim": (F.col("depth"), brain, 40)})
    around, deep, cortex = (F.col("near").between(1, 10)) & normal, normal & (F.col("depth") > F.col("__deep")), normal & (F.col("depth") < F.col("__rim"))
    a = t.groupBy("case_id").agg(
        F.count_if(normal).alias("n"), F.count_if(brain).alias("nb"), F.count_if(around).alias("na"), F.count_if(deep).alias("nd"), F.count_if(cortex).alias("nc"), F.first(voxel_cm3()).alias("cm3"),
        F.avg(F.when(around, F.col("flair"))).alias("fa"), F.avg(F.when(cortex, F.col("flair"))).alias("fc"), F.avg(F.when(deep, F.col("t1"))).alias("td"), F.avg(F.when(cortex, F.col("t1"))).alias("tc"),
    )
    pv = F.when((F.col("na") > 0) & (F.col("fc") > 0), F.col("fa") / F.col("fc")).otherwise(1.0)
    grey = F.when(F.col("nc") > 100, F.col("tc")).otherwise(F.col("td"))
    gw = F.when((F.col("nd") > 100) & (grey > 0), F.col("td") / grey).otherwise(1.0)
    a = a.withColumn("pv", pv).withColumn("gw", gw)
    disease = F.when(F.col("na") > 0, F.col("pv") > 1.15).otherwise(False)
    kept = F.when(F.col("nd") <= 100, "Could not assess").when(F.col("gw") > 1.1, "Preserved").when(F.col("gw") > 1.0, "Mildly reduced").otherwise("Reduced")
    return a.withColumn("white_matter_disease", disease).withColumn("differentiation", kept).select(
        "case_id", (F.col("n") * F.col("cm3")).alias("normal_cm3"), (F.col("nb") * F.col("cm3")).alias("brain_cm3"), "pv", "white_matter_disease", "gw", "differentiation",
        F.when(F.col("n") == 0, "Unable to assess").when(~F.col("white_matter_disease") & (F.col("differentiation") == "Preserved"), "Normal").otherwise("Abnormal findings present").alias("overall"),
    )


def vessels(df: DataFrame) -> DataFrame:
    """Flow voids at the base and enhancement around the tumour."""
    t = G.known(flow_voids(brain_mask(df)), {"near": ("wt_near", "l1", region("wt"))})
    rim = F.col("near").between(1, 10) & F.col("brain")
    a = t.groupBy("case_id").agg(
        F.count_if(F.col("inferior")).alias("ni"), F.count_if(F.col("void")).alias("nv"), F.first(voxel_cm3()).alias("cm3"), F.count_if(rim).alias("nr"),
        F.avg(F.when(rim, F.col("t1"))).alias("a"), F.avg(F.when(rim, F.col("t1ce"))).alias("b"),
    )
    f, r = F.col("nv") / F.col("ni"), F.when((F.col("nr") > 0) & (F.col("a") > 0), F.col("b") / F.col("a")).otherwise(1.0)
    return a.select(
        "case_id", (F.col("nv") * F.col("cm3")).alias("void_cm3"),
        F.when(F.col("ni") == 0, "Could not assess").when((f > 0.001) & (f < 0.05), "Present").when(f < 0.001, "Not well visualized").otherwise("Prominent").alias("flow_voids"),
        r.alias("peritumoral_ratio"), F.when(F.col("nr") == 0, "Could not assess").when(r > 1.5, "Possible").otherwise("Not evident").alias("involvement"),
    )
