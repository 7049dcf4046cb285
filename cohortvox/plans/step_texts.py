"""The six step texts of a case and the comprehensive report, from its findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cohortvox.functions.text import capitalized
from cohortvox.operators import quality as Q
from cohortvox.plans import wording as W
from cohortvox.plans.summary import NOT_GIVEN, PATTERNS, differentials, strings

STEPS = ("sequences", "mass_effect", "multiplicity", "morphology", "quality", "structures")
TITLES = (
    "1. SEQUENCE-SPECIFIC FINDINGS", "2. MASS EFFECT AND ANATOMICAL LOCATION", "3. LESION MULTIPLICITY AND DISTRIBUTION", "4. TUMOR MORPHOLOGY AND MARGINS",
    "5. QUALITY CONTROL", "6. NORMAL STRUCTURES",
)


def _text(*parts: str | Column) -> Column:
    """The lines that are not null; a part is a text, a line or a list of lines."""
    arrays = []
    for p in parts:
        arrays.append(F.array(F.lit(p)) if isinstance(p, str) else p)
    lines = F.concat(*[F.coalesce(a, strings()) for a in arrays])
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def _line(pattern: str, *values: str | Column, when: Column | None = None) -> Column:
    """One line, or none where a value is null or ``when`` does not hold."""
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    ok = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    for c in cols:
        ok = ok & c.isNotNull()
    return F.array(F.when(ok, F.format_string(pattern, *cols)))


def _each(rows: str, line: Callable[[Column], Column], when: Column | None = None) -> Column:
    out = F.transform(F.col(rows), line)
    return out if when is None else F.when(when, out)


def sequence_text() -> Column:
    c, s = F.col, F.format_string
    contrast = F.when(c("tech_contrast"), "Administered (Gadolinium-based contrast agent (inferred from T1ce sequence presence))").otherwise("Not administered or not available")
    region = F.create_map(*[F.lit(x) for kv in W.REGIONS.items() for x in kv])
    rows = F.flatten(F.transform("signals", lambda r: F.array(
        F.concat(F.lit("  "), region[r["region"]], F.lit(":")), F.concat(F.lit("    "), r["signal_summary"]),
        s("    Ratios - T1: %.2f, T2: %.2f, FLAIR: %.2f, T1ce: %.2f", r["t1_ratio"], r["t2_ratio"], r["flair_ratio"], r["t1ce_ratio"]),
    )))
    odd = F.element_at(F.filter("signals", lambda r: r["region"] == c("mis_region")), 1)
    volumes = [_line(f"  - {W.REGIONS[k]}: %.2f cm³", f"{k}_cm3", when=c(f"{k}_cm3") > 0) for k in ("wt", "tc", "et", "ncr", "ed")]
    unknown = [f"  {k}: {NOT_GIVEN}" for k in ("Patient age", "Patient sex", "Clinical history", "Presenting symptoms")]
    return _text(
        "CLINICAL INFORMATION:", *unknown, "  [Note: Do not fabricate - include only if provided in clinical records]", "", "TECHNIQUE:",
        _line("  Sequences performed: %s", F.when(F.size("tech_performed") > 0, F.array_join("tech_performed", ", ")).otherwise(NOT_GIVEN)), _line("  Contrast: %s", contrast),
        _line("  Slice thickness: %s mm", c("tech_slice_thickness_mm").cast("string")),
        _line("  In-plane resolution: %.2f × %.2f mm", c("tech_in_plane_resolution_mm")[0], c("tech_in_plane_resolution_mm")[1]),
        _line("  Matrix size: %d × %d × %d", *[c("tech_matrix_size")[k] for k in range(3)]),
        _line("  Not available: %s", F.array_join("tech_not_available", ", "), when=F.size("tech_not_available") > 0),
        "", "SEQUENCE-SPECIFIC FINDINGS:", "", "Reference: Normal brain tissue (combined GM+WM, excluding tumor and CSF)", "", "Signal Characteristics by Region:", rows,
        "", _line("Contrast Enhancement: %s", "enh_pattern"), _line("  Strength: %s", "enh_strength"), _line("  Heterogeneity: %s", "enh_heterogeneity"),
        _line("  %s", W.described(W.ENHANCEMENT, c("enh_pattern"))),
        "", _line("T2/FLAIR Mismatch: %s", F.when(c("mis_mismatch"), "Present").otherwise("Not detected")),
        _line("  %s", F.when(c("mis_mismatch"), s(W.MISMATCH, region[odd["region"]], odd["t2_ratio"], odd["flair_ratio"])).otherwise(W.NO_MISMATCH)),
        "", "Tumor Volumes:", *volumes, "", "Note: Diffusion-weighted imaging (DWI/ADC) not available in the standard dataset",
    )


def mass_effect_text() -> Column:
    c = F.col
    lobes = F.filter(F.split("place_lobes", ","), lambda v: (v != "") & (F.replace(v, F.lit(" "), F.lit("_")) != c("place_primary_lobe")))
    many = F.size(F.split("place_lobes", ",")) > 1
    shifted = c("shift_significant")
    return _text(
        "MASS EFFECT ANALYSIS:", "", "Anatomical Location:", _line("  - Laterality: %s", "place_laterality"),
        _line("  - Primary lobe: %s (%.0f%%)", capitalized(c("place_primary_lobe")), "place_primary_percent"), _line("  - Additional involvement: %s", F.array_join(lobes, ", "), when=many),
        _line("  - Depth: %s", "place_depth"),
        _line("  - Gyri (estimated): %s", F.replace("place_gyri", F.lit(","), F.lit(", ")), when=~c("place_gyri").isin("", "gyral localization not determined")),
        "", _line("Midline Shift: %s (%.1f mm)", "shift_severity", "shift_shift_mm", when=shifted), _line("  - Direction: %s", "shift_direction", when=shifted),
        F.when(~shifted, strings("Midline Shift: None", "  - No significant midline shift detected")), _line("  - Tumor hemisphere: %s", "shift_tumor_hemisphere"),
        "", _line("Ventricular System: %s", "comp_severity"), _line("  - Compressed side: %s", "comp_compressed_side", when=c("comp_asymmetry") > 0.15),
        _line("  - Asymmetry ratio: %.2f", "comp_asymmetry", when=c("comp_asymmetry") > 0.15), _line("  - Tumor-ventricle distance: %.1f mm", "comp_distance_mm", when=c("comp_distance_mm") > 0),
        "", _line("Sulcal Effacement: %s", "sulci_severity"), "", _line("Herniation Risk Assessment: %s", "risk_risk"), _line("  - Mass effect score: %.1f/7", "risk_score"),
        F.transform(F.split("risk_signs", "; "), lambda x: F.concat(F.lit("  - "), x)),
    )


def multiplicity_text() -> Column:
    c, s = F.col, F.format_string
    n = c("multi_lesions")
    first = F.element_at("lesions", 1)
    worded = lambda k: W.described({p: v[k] for p, v in PATTERNS.items()}, c("multi_pattern"))
    may = differentials(c("multi_pattern"))
    none = _text("LESION MULTIPLICITY AND DISTRIBUTION:", "", _line("Lesion Count: %d", n), "  No tumor lesions detected")
    some = _text(
        "LESION MULTIPLICITY AND DISTRIBUTION:", "", _line("Lesion Count: %d", n),
        _line("  Primary lesion: %.2f cm³, max diameter %.1f mm", first["volume_cm3"], first["max_diameter_mm"]),
        F.array(F.when(c("lesion_enhancing"), "    - Contains enhancing component").otherwise("    - Non-enhancing")),
        _line("  Secondary lesions: %d", n - 1, when=n > 1),
        F.when(n > 1, F.transform(F.slice("lesions", 2, F.greatest(F.lit(1), n.cast("int"))), lambda r: s("    - Lesion #%d: %.2f cm³", r["rank"], r["volume_cm3"]))),
        F.when(n > 1, strings("", "Inter-lesion Distances:")), _line("  - Minimum: %.1f mm", "multi_min_mm", when=n > 1), _line("  - Maximum: %.1f mm", "multi_max_mm", when=n > 1),
        F.when(c("multi_satellites") > 0, F.array(F.lit(""), s("Satellite Lesions: %d", "multi_satellites"))),
        _each("satellites", lambda r: s("  - %.1f mm from primary, %.2f cm³", r["distance_mm"], r["volume_cm3"])),
        "", _line("Enhancing Foci: %s", "multi_foci_pattern"), _line("  - Total enhancing volume: %.2f cm³", "multi_enhancing_cm3", when=c("multi_foci") > 0),
        "", _line("Distribution Pattern: %s", "multi_pattern"), _line("  %s", worded(0)), _line("  Clinical implication: %s", worded(1)),
        F.when(F.size(may) > 0, F.concat(strings("  Differential considerations:"), F.transform(may, lambda d: F.concat(F.lit("    - "), d)))),
    )
    return F.when(n == 0, none).otherwise(some)


def morphology_text() -> Column:
    c = F.col
    present = c("nec_present")
    worded = F.format_string("%s", W.described(W.NECROSIS, c("nec_pattern")))
    worded = F.when(F.contains(worded, F.lit("%.0f%%")), F.replace(worded, F.lit("%.0f%%"), F.format_string("%.0f%%", "nec_percent"))).otherwise(worded)
    return _text(
        "TUMOR MORPHOLOGY AND MARGINS:", "", _line("Shape: %s", "shape_shape_class"), _line("  - Volume: %.2f cm³", "shape_volume_cm3"), _line("  - Surface area: %.0f mm²", "shape_surface_mm2"),
        _line("  - Sphericity: %.2f (%s)", "shape_sphericity", F.lower("shape_shape_class")), _line("  - Elongation: %.2f (%s)", "shape_elongation", F.lower("shape_elongation_class")),
        "", _line("Contour Shape: %s", "border_classification"), "  (Measures outer surface smoothness, not intensity transition)", _line("  %s", W.described(W.BORDER, c("border_classification"))),
        "", _line("Margin Transition: %s", "margin_classification"), "  (Measures tumor-brain intensity demarcation)", _line("  %s", W.described(W.MARGIN, c("margin_classification"))),
        "", _line("Morphology Summary: %s contour with %s margins", "border_classification", F.lower("margin_classification")),
        "", _line("Necrosis: %s", "nec_pattern"), _line("  - Volume: %.2f cm³ (%.0f%% of tumor)", "nec_necrosis_cm3", "nec_percent", when=present), _line("  - Location: %s", "nec_location", when=present),
        _line("  %s", worded),
        "", _line("Cystic/Solid: %s", "cyst_classification"), _line("  - Solid: %.0f%%, Cystic: %.0f%%", "cyst_solid_percent", "cyst_cystic_percent"), _line("  %s", W.described(W.CYSTIC, c("cyst_classification"))),
        _line("  - T2 signal: %s", "cyst_t2_homogeneity"), _line("  - FLAIR: %s", "cyst_flair_suppression"),
    )


def quality_text(model: str) -> Column:
    """Ends with the first three limitations and all caveats."""
    c, s = F.col, F.format_string
    listed = lambda n: F.filter(F.split(n, "; "), lambda v: v != "")
    issues, warned = listed("seg_issues"), listed("seg_warnings")
    under = lambda title, rows, mark: F.when(F.size(rows) > 0, F.concat(strings(title), F.transform(rows, lambda v: F.concat(F.lit(mark), v))))
    detected = F.filter(F.split("art_artifacts", ", "), lambda v: v != "")
    whole = F.when(F.size(detected) == 0, "No significant artifacts detected").when(F.size(detected) <= 2, F.concat(F.lit("Minor artifacts detected: "), "art_artifacts")).otherwise(F.concat(F.lit("Multiple artifacts present: "), "art_artifacts"))
    trust = [f"  - {k.replace('_', ' ').title()}: {v}" for k, v in Q.CONFIDENCE.items()]
    return _text(
        "QUALITY CONTROL AND CONFIDENCE ASSESSMENT:", "", _line("Segmentation Quality: %s (Score: %d/100)", "seg_grade", "seg_score"), _line("  %s", W.described(W.SEGMENTATION, c("seg_grade"))),
        under("  Issues:", issues, "    ⚠ "), under("  Warnings:", warned, "    ⚡ "),
        "", _line("Image Quality: %s", "img_overall"), _each("sequences", lambda r: s("  - %s: %s (SNR ≈ %.1f)", r["sequence"], r["quality"], r["snr"])),
        "", _line("Artifact Assessment: %s", "art_severity"), _line("  %s", whole), F.transform(detected, lambda v: F.concat(F.lit("    • "), v)),
        "", "Measurement Confidence:", *trust, "", "Key Limitations:", *[f"  • {x.format(model=model)}" for x in W.LIMITATIONS[:3]],
        F.when(F.size("caveats") > 0, F.concat(strings("", "Case-Specific Caveats:"), F.transform("caveats", lambda v: F.concat(F.lit("  • "), v)))),
    )


def structure_text() -> Column:
    c = F.col
    around = F.when(c("tissue_pv").isNull(), "Periventricular region could not be assessed").when(c("tissue_pv") > 1.3, "FLAIR hyperintensities in periventricular white matter, may represent chronic small vessel disease")
    around = around.when(c("tissue_pv") > 1.15, "Mild periventricular FLAIR signal changes").otherwise("No significant periventricular white matter changes")
    return _text(
        "NORMAL STRUCTURES ASSESSMENT:", "", "Ventricular System:", _line("  - Size: %s (VBR: %.1f%%)", "vent_size", "vent_vbr"),
        _line("  - Volume: %.1f cm³ (L: %.1f, R: %.1f)", "vent_total_cm3", "vent_left_cm3", "vent_right_cm3"), _line("  - Symmetry: %s", "vent_symmetry"), _line("  - %s", "vent_hydrocephalus"),
        F.when(c("vent_obstruction") > 0.1, strings("  - ⚠ Tumor adjacent to ventricular system")),
        "", "Brain Parenchyma:", _line("  - Gray-white differentiation: %s", "tissue_differentiation"), _line("    %s", W.described(W.GREY_WHITE, c("tissue_differentiation"))),
        _line("  - Periventricular white matter: %s", around), _line("  - Overall: %s", "tissue_overall"),
        "", "Major Vessels (Limited Assessment):", _line("  - Flow voids: %s", "ves_flow_voids"), _line("  - Vascular involvement: %s", "ves_involvement"),
        "  Note: Limited assessment on structural sequences",
    )


def step_texts(found: DataFrame, model: str = "segmentation") -> DataFrame:
    """``(case_id, sequences, mass_effect, multiplicity, morphology, quality, structures)``: a text for each step."""
    made = (sequence_text(), mass_effect_text(), multiplicity_text(), morphology_text(), quality_text(model), structure_text())
    return found.select("case_id", *[t.alias(n) for n, t in zip(STEPS, made, strict=True)])


def comprehensive_report(found: DataFrame, date: str, model: str = "segmentation") -> DataFrame:
    """``(case_id, report)``: the key findings and all step texts under their titles."""
    bar, rule = "=" * 70, "-" * 70
    texts = [sequence_text(), mass_effect_text(), multiplicity_text(), morphology_text(), quality_text(model), structure_text()]
    parts: list[str | Column] = [
        bar, "BRAIN MRI TUMOR ANALYSIS REPORT", bar, "", _line("Case ID: %s", F.col("case_id").cast("string")), f"Analysis Date: {date}", f"Model: {model}", "",
        rule, "EXECUTIVE SUMMARY", rule, _line("• Tumor Volume: %.1f cm³", "wt_cm3"), _line("• Location: %s lobe, %s", capitalized(F.col("place_primary_lobe")), "place_laterality"),
        _line("• Enhancement: %s", "enh_pattern"), _line("• Lesion Count: %d", "multi_lesions"), _line("• Quality Score: %d/100", "seg_score"), "",
    ]
    for title, text in zip(TITLES, texts, strict=True):
        parts += [rule, title, rule, F.array(text), ""]
    return found.select("case_id", _text(*parts, bar, "END OF REPORT", bar).alias("report"))
