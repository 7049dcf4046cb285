"""All findings of a case in one row, and its nested summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortvox.functions.text import present
from cohortvox.operators import components as C, grid as G, intensity as I, mass_effect as X, morphology as S, quality as Q, structures as N
from cohortvox.operators.masks import brain_mask, csf_candidate, csf_mask, region
from cohortvox.plans.wording import CYSTIC, described
from cohortvox.sources.manifest import UNAVAILABLE
from cohortvox.sources.workspace import Workspace

NOT_GIVEN = "<not provided>"


def ring(df: DataFrame) -> DataFrame:
    d = G.known(df, {"near": ("ncr_near", "l1", region("ncr"))})
    return d.groupBy("case_id").agg(F.count_if(region("et")).alias("et"), F.count_if(region("ncr")).alias("ncr"), F.count_if(region("et") & (F.col("near") <= 2)).alias("rim"))


def laterality_check(location: DataFrame, shift: DataFrame) -> DataFrame:
    """Whether the two ways of finding the side agree; a bilateral tumour agrees with either."""
    j = location.select("case_id", "hemisphere").join(shift.select("case_id", "tumor_hemisphere"), "case_id")
    a, b = F.col("hemisphere"), F.coalesce("tumor_hemisphere", F.lit("Unknown"))
    both = F.contains(a, F.lit("bilateral"))
    agree = both | (F.lower(F.split_part(a, F.lit("-"), F.lit(1))) == F.lower(b))
    note = F.when(both, "Bilateral tumor - crosses midline").when(agree, "Hemisphere determination consistent across methods").otherwise(
        F.format_string("Hemisphere mismatch: location analysis suggests %s, centroid analysis suggests %s. Tumor may be near midline.", a, b))
    return j.select("case_id", a.alias("location_method"), b.alias("centroid_method"), agree.alias("consistent"), note.alias("note"))


#: What a noisy sequence affects, as named and as worded.
AFFECTED = {
    "T2": ("necrosis_fraction,cystic_solid_classification,edema_extent", "necrosis/cystic fraction and edema measurements"),
    "T1ce": ("enhancement_analysis,margin_sharpness", "enhancement and margin measurements"),
}


def reliability_warnings(per_sequence: DataFrame, overall: DataFrame) -> DataFrame:
    """``(case_id, sequence, affected, warning)`` for noisy sequences and for fair or poor images."""
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for s, v in AFFECTED.items() for x in (s, v[k])]), F.col("sequence"))
    low = per_sequence.where(F.col("sequence").isin(*AFFECTED) & (F.col("snr") < 6))
    text = F.format_string("Low %s SNR (%.1f) may reduce reliability of %s", F.col("sequence"), F.col("snr"), pick(1))
    rows = low.select("case_id", "sequence", pick(0).alias("affected"), text.alias("warning"))
    all_ = F.format_string("Overall image quality is %s; interpret quantitative measurements with caution", F.col("overall"))
    bad = overall.where(F.col("overall").isin("Fair", "Poor"))
    return rows.unionByName(bad.select("case_id", F.lit("all").alias("sequence"), F.lit("").alias("affected"), all_.alias("warning")))


#: How a distribution pattern is worded, what it implies, and what it may be.
PATTERNS = {
    "Solitary": ("Single contiguous lesion", "Unifocal disease, typical for primary brain tumor", ("Primary glioma", "Solitary metastasis", "Lymphoma", "Abscess")),
    "Primary with satellites": (
        "Main lesion with satellite nodules", "Suggests local tumor spread or infiltrative growth pattern",
        ("High-grade glioma with infiltration", "Multicentric glioma", "Inflammatory process"),
    ),
    "Regional multifocal": (
        "Few lesions in regional distribution", "Regional disease, may be contiguous or multicentric",
        ("Multicentric glioma", "Regional metastases", "Demyelinating disease"),
    ),
    "Distant multifocal": (
        "Separate lesions in different brain regions", "Multifocal disease, consider metastatic process",
        ("Metastatic disease", "Multicentric glioma", "CNS lymphoma", "Multifocal infection"),
    ),
    "Diffuse/scattered": (
        "Multiple lesions throughout brain", "Diffuse disease pattern, high probability of metastatic or systemic process",
        ("Metastatic carcinoma", "CNS lymphoma", "Miliary tuberculosis", "Septic emboli"),
    ),
    "No tumor": ("No lesion detected", "N/A", ()),
}
#: Sequences by column, and the notes of a summary.
SEQUENCE_NAMES = {"t1": "T1", "t1ce": "T1ce", "t2": "T2", "flair": "FLAIR"}
PATIENT_NOTE = "DO NOT fabricate patient demographics or clinical history. Only include information explicitly provided in clinical records."
TECHNIQUE_NOTE = "LLM must only reference sequences listed in sequences_performed; do not infer or guess additional sequences"
CONTRAST_NOTE = "Gadolinium-based contrast agent (inferred from T1ce sequence presence)"


def strings(*items: str) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def differentials(pattern: Column) -> Column:
    """What a distribution pattern may be; empty for an unknown one."""
    out = strings()
    for name, (_, _, may) in PATTERNS.items():
        out = F.when(pattern == name, strings(*may)).otherwise(out)
    return out


def technique(grid: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """``(case_id, performed, not_available, contrast, slice_thickness_mm, in_plane_resolution_mm, voxel_size_mm, matrix_size, num_slices)``.

    ``available`` is ``manifest.availability``; without it a sequence counts as
    performed where a case has any signal of it.
    """
    a = grid.groupBy("case_id").agg(*[F.max(F.col(k) > 0).alias(k) for k in SEQUENCE_NAMES], *[F.first(k).alias(k) for k in ("nx", "ny", "nz", "dx", "dy", "dz")])
    if available is None:
        have, lack = present(*[F.when(F.col(k), F.lit(n)) for k, n in SEQUENCE_NAMES.items()]), present(*[F.when(~F.col(k), F.lit(n)) for k, n in SEQUENCE_NAMES.items()])
        a = a.select("*", have.alias("performed"), F.concat(lack, strings(*UNAVAILABLE)).alias("not_available"), F.col("t1ce").alias("contrast"))
    else:
        listed = lambda c: F.filter(F.split(c, ","), lambda v: v != "")
        a = a.join(available.select("case_id", listed("performed").alias("performed"), listed("not_available").alias("not_available"), "contrast"), "case_id", "left")
    return a.select(
        "case_id", "performed", "not_available", "contrast", F.col("dz").alias("slice_thickness_mm"), F.array("dx", "dy").alias("in_plane_resolution_mm"),
        F.array("dx", "dy", "dz").alias("voxel_size_mm"), F.array("nx", "ny", "nz").alias("matrix_size"), F.col("nz").alias("num_slices"),
    )


def _ordered(df: DataFrame, order: Column, fields: list[str], name: str) -> DataFrame:
    """``(case_id, name)``: the rows of a case as one list of structs (a few rows a case)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("k"), F.struct(*fields).alias("v"))))
    return df.groupBy("case_id").agg(F.transform(rows, lambda r: r["v"]).alias(name))


def prepared(grid: DataFrame, ws: Workspace) -> DataFrame:
    """``grid`` with the brain and, where cases fit a block, the masks and fields of all steps by one pass; else each step makes its own."""
    if not G.whole_cases(grid):
        return ws.table(brain_mask(grid), "grid")
    b = ws.table(brain_mask(grid).repartition("case_id").sortWithinPartitions("case_id"), "brain")
    m = csf_mask(csf_candidate(b).withColumnRenamed("csf", "candidate"))
    wt = region("wt")
    return ws.table(G.fields(m, {
        "ncr_near": ("l1", region("ncr")), "wt_near": ("l1", wt), "wt_depth": ("l1_depth", wt), "wt_slope": ("signed_slope", wt), "t1_sobel": ("sobel", F.col("t1").cast("double")),
        "candidate_far": ("edt", F.col("candidate")), "fluid": ("opened", F.col("csf")), "brain_depth": ("edt", ~F.col("brain")),
    }), "grid")


def findings(grid: DataFrame, ws: Workspace, ventricle_voxels: int = 1000, available: DataFrame | None = None) -> DataFrame:
    """All findings of every case in one row, columns named by their step; operators share one stored grid."""
    g = prepared(grid, ws)
    plain = g.select(*grid.columns)
    keep = lambda df, name: ws.table(df, name)
    volume = keep(I.volumes_cm3(g), "volume")
    shift, vent, sulci = keep(X.midline_shift(g), "shift"), keep(X.ventricular_compression(g), "compression"), keep(X.sulcal_effacement(g), "sulci")
    place = keep(X.location(g), "location")
    signals = keep(I.region_signals(g), "signals")
    stats = keep(C.component_stats(C.label(plain, region("wt"), ws)), "components")
    foci = C.component_stats(C.label(plain, F.col("seg") == 3, ws))
    multi = keep(C.multiplicity(g, stats, foci), "multiplicity")
    ranked = keep(C.lesions(stats), "lesions")
    images = keep(Q.image_quality(g), "images")
    overall = keep(Q.overall_quality(images), "overall")
    segmentation = keep(Q.segmentation_quality(g, ws, stats), "segmentation")
    found = keep(N.ventricles(g.select(*grid.columns, *[c for c in ("brain", "csf", "fluid", "wt_near", "brain_depth") if c in g.columns]), ws, ventricle_voxels), "ventricles")
    system, tissue = keep(N.ventricular_system(g, ws, found=found), "system"), keep(N.parenchyma(g, ws, found=found), "tissue")
    renamed = lambda df, p: df.select("case_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "case_id"])
    parts = [volume]
    parts += [renamed(df, p) for df, p in (
        (ranked.where("rank = 1").select("case_id", "max_diameter_mm", (F.col("et") > 0).alias("enhancing")), "lesion"), (shift, "shift"), (vent, "comp"), (sulci, "sulci"),
        (X.herniation(shift, vent, sulci, volume), "risk"), (place, "place"), (multi, "multi"), (I.enhancement(signals, ring(g)), "enh"), (I.t2_flair_mismatch(signals), "mis"),
        (S.shape(g), "shape"), (S.border(g), "border"), (S.margin(g), "margin"), (S.necrosis(g), "nec"), (S.cystic(g), "cyst"),
        (segmentation, "seg"), (overall, "img"), (Q.artifacts(g), "art"), (system, "vent"), (tissue, "tissue"), (N.vessels(g), "ves"), (laterality_check(place, shift), "side"),
        (technique(g, available), "tech"),
    )]
    order = F.create_map(*[F.lit(x) for kv in I.SIGNAL_REGIONS.items() for x in kv])[F.col("region")]
    parts += [
        _ordered(signals, order, ["region", "signal_summary", "t1_ratio", "t2_ratio", "flair_ratio", "t1ce_ratio"], "signals"),
        _ordered(ranked, F.col("rank"), ["rank", "volume_cm3", "max_diameter_mm", "et"], "lesions"),
        _ordered(C.lesion_pairs(ranked).where((F.col("rank1") == 1) & (F.col("distance_mm") < C.SATELLITE_MM)), F.col("rank2"), ["distance_mm", "volume_cm3"], "satellites"),
        _ordered(images, F.array_position(strings(*SEQUENCE_NAMES.values()), F.col("sequence")), ["sequence", "quality", "snr"], "sequences"),
        _ordered(reliability_warnings(images, overall), F.col("warning"), ["sequence", "affected", "warning"], "warnings"),
        Q.caveats(segmentation, overall, g.groupBy("case_id").agg(F.count_if(region("et")).alias("et"))),
    ]
    return ws.table(beside(parts), "findings")


def beside(parts: list[DataFrame]) -> DataFrame:
    """Tables with a row per case at most and columns of their own, side by side by one shuffle; cases are those of the first."""
    cols = {c: k for k, df in enumerate(parts) for c in df.columns if c != "case_id"}
    out = parts[0].withColumn("__case", F.lit(True))
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    g = out.groupBy("case_id").agg(F.max("__case").alias("__case"), *[F.first(c, ignorenulls=True).alias(c) for c in cols])
    return g.where("__case").select("case_id", *cols)


def compile_summary(found: DataFrame, date: str | None = None) -> DataFrame:
    """The nested summary of every case from its ``findings``."""
    c = F.col
    given = F.lit(NOT_GIVEN)
    entries = F.transform("signals", lambda r: F.struct(r["region"].alias("region"), F.struct(
        r["signal_summary"].alias("signal_summary"), r["t1_ratio"].alias("T1_ratio"), r["t2_ratio"].alias("T2_ratio"), r["flair_ratio"].alias("FLAIR_ratio"), r["t1ce_ratio"].alias("T1ce_ratio"))))
    graded = F.transform("sequences", lambda r: F.struct(r["sequence"].alias("sequence"), r["quality"].alias("quality")))
    level = lambda want: strings(*sorted(k for k, v in Q.CONFIDENCE.items() if v == want))
    listed = lambda n: F.filter(F.split(n, ","), lambda v: v != "")
    return found.select(
        "case_id", F.lit(date).cast("string").alias("analysis_date"),
        F.struct(*[given.alias(k) for k in ("age", "sex", "clinical_history", "presenting_symptoms", "relevant_prior_imaging")], F.lit(PATIENT_NOTE).alias("note")).alias("patient_info"),
        F.struct(
            c("tech_performed").alias("sequences_performed"), c("tech_not_available").alias("sequences_not_available"), c("tech_contrast").alias("contrast_administered"),
            F.when(c("tech_contrast"), CONTRAST_NOTE).otherwise("No post-contrast imaging available").alias("contrast_note"),
            F.struct(*[c(f"tech_{k}").alias(k) for k in ("slice_thickness_mm", "in_plane_resolution_mm", "voxel_size_mm", "matrix_size", "num_slices")]).alias("acquisition_parameters"),
            F.lit(TECHNIQUE_NOTE).alias("note"),
        ).alias("technique"),
        F.struct(c("wt_cm3").alias("volume_cm3"), c("et_cm3").alias("enhancing_volume_cm3"), c("ncr_cm3").alias("necrotic_volume_cm3"), c("ed_cm3").alias("edema_volume_cm3"), F.coalesce("lesion_max_diameter_mm", F.lit(0.0)).alias("max_diameter_mm")).alias("tumor_characteristics"),
        F.struct(
            c("place_hemisphere").alias("hemisphere"), c("place_laterality").alias("laterality"), c("place_primary_lobe").alias("primary_lobe"), listed("place_lobes").alias("involved_lobes"),
            c("place_depth").alias("depth"), listed("place_gyri").alias("gyri"),
            F.struct(*[c(f"side_{k}").alias(k) for k in ("location_method", "centroid_method", "consistent", "note")]).alias("laterality_validation"),
        ).alias("location"),
        F.map_from_entries(entries).alias("signal_characteristics"),
        F.struct(c("enh_present").alias("present"), c("enh_pattern").alias("pattern"), F.coalesce("enh_strength", F.lit("None")).alias("strength"), F.coalesce("enh_heterogeneity", F.lit("N/A")).alias("heterogeneity")).alias("enhancement"),
        F.struct(c("shift_shift_mm").alias("midline_shift_mm"), c("shift_significant").alias("shift_significant"), c("shift_direction").alias("shift_direction"), c("risk_risk").alias("herniation_risk"), c("risk_score").alias("mass_effect_score")).alias("mass_effect"),
        F.struct(
            F.lower(F.coalesce("shape_shape_class", F.lit("mass"))).alias("shape"), c("shape_sphericity").alias("sphericity"), c("shape_elongation").alias("elongation"),
            c("border_classification").alias("contour_shape"), F.lit("outer_surface_smoothness").alias("contour_concept"), c("margin_classification").alias("margin_transition"),
            F.lit("intensity_transition_sharpness").alias("margin_concept"), c("margin_sharpness").alias("margin_sharpness"),
            F.concat("border_classification", F.lit(" contour with "), F.lower("margin_classification"), F.lit(" margins")).alias("combined_description"),
        ).alias("morphology"),
        F.struct(c("nec_present").alias("present"), c("nec_pattern").alias("pattern"), c("nec_percent").alias("percentage"), F.coalesce("nec_location", F.lit("N/A")).alias("location")).alias("necrosis"),
        F.struct(c("cyst_classification").alias("classification"), c("cyst_cystic_percent").alias("cystic_percentage"), c("cyst_solid_percent").alias("solid_percentage"), described(CYSTIC, c("cyst_classification")).alias("description")).alias("cystic_solid"),
        F.struct(c("multi_lesions").cast("int").alias("lesion_count"), (c("multi_lesions") == 1).alias("is_single_lesion"), c("multi_pattern").alias("distribution_pattern"), (c("multi_satellites") > 0).alias("has_satellites")).alias("multiplicity"),
        F.struct(F.struct(c("vent_size").alias("size"), c("vent_total_cm3").alias("volume_cm3"), (c("vent_hydrocephalus") != "No hydrocephalus").alias("hydrocephalus"), c("vent_symmetry").alias("symmetry")).alias("ventricular_system"), F.struct(c("tissue_differentiation").alias("gray_white_differentiation"), c("tissue_white_matter_disease").alias("white_matter_disease"), c("tissue_overall").alias("overall")).alias("parenchyma")).alias("normal_structures"),
        F.struct(
            c("seg_score").alias("segmentation_score"), c("seg_grade").alias("segmentation_grade"), c("img_overall").alias("image_quality"), F.map_from_entries(graded).alias("sequence_quality"),
            F.struct(F.filter(F.split("art_artifacts", ", "), lambda v: v != "").alias("detected"), c("art_severity").alias("severity"), c("art_impact").alias("impact")).alias("artifacts"),
            level("High").alias("confidence_high"), level("Moderate").alias("confidence_moderate"),
        ).alias("quality_metrics"),
        F.coalesce("warnings", F.array().cast(found.schema["warnings"].dataType)).alias("measurement_reliability_warnings"),
        differentials(c("multi_pattern")).alias("differential_considerations"), "caveats",
    )


def summarize(grid: DataFrame, ws: Workspace, ventricle_voxels: int = 1000, available: DataFrame | None = None, date: str | None = None) -> DataFrame:
    """The nested summary of every case of a grid."""
    return ws.table(compile_summary(findings(grid, ws, ventricle_voxels, available), date), "summary")


def flat_metrics(summary: DataFrame) -> DataFrame:
    """The nine figures shown for a case, with defaults; Dice is not part of a summary."""
    t, m = "tumor_characteristics", "multiplicity"
    return summary.select(
        "case_id", F.coalesce(F.col(f"{t}.volume_cm3"), F.lit(0.0)).alias("volume_cm3"), F.coalesce(F.col(f"{t}.max_diameter_mm"), F.lit(0.0)).alias("max_diameter_mm"),
        F.coalesce(F.col("mass_effect.midline_shift_mm"), F.lit(0.0)).alias("midline_shift_mm"), F.coalesce(F.col(f"{m}.lesion_count"), F.lit(1)).alias("lesion_count"),
        F.coalesce(F.col("location.hemisphere"), F.lit("unknown")).alias("hemisphere"), F.coalesce(F.col("location.primary_lobe"), F.lit("unknown")).alias("primary_lobe"),
        F.coalesce(F.col("enhancement.pattern"), F.lit("unknown")).alias("enhancement_pattern"), F.coalesce(F.col("necrosis.percentage"), F.lit(0.0)).alias("necrosis_percent"), F.lit(None).cast("double").alias("dice"),
    )


def write_json(summary: DataFrame, folder: str) -> None:
    summary.write.mode("overwrite").json(folder)


def read_json(spark, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(folder)
