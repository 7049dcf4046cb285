"""Registered queries over whole summaries, corrected reports, the built-in definitions and guarded scores, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortvox.operators import evaluate as E, retrieval as R
from cohortvox.plans import cohort_queries as Q, report as P, step_texts as ST, summary as S, wording as W
from cohortvox.plans.report_queries import FACTS, case_summaries, masked, validated
from cohortvox.plans.text_queries import _quoted, found, summary
from cohortvox.sources.voxels import grid, volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return add


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Column of the flat summary: (field of the summary, SQL over the twins of the steps).
FIELDS = {
    "volume_cm3": ("tumor_characteristics.volume_cm3", "v.wt_cm3"),
    "enhancing_cm3": ("tumor_characteristics.enhancing_volume_cm3", "v.et_cm3"),
    "necrotic_cm3": ("tumor_characteristics.necrotic_volume_cm3", "v.ncr_cm3"),
    "edema_cm3": ("tumor_characteristics.edema_volume_cm3", "v.ed_cm3"),
    "max_diameter_mm": ("tumor_characteristics.max_diameter_mm", f"coalesce(CASE WHEN l.volume_cm3 >= {0.1} THEN l.max_diameter_mm END, 0.0)"),
    "hemisphere": ("location.hemisphere", "p.hemisphere"), "laterality": ("location.laterality", "p.laterality"), "primary_lobe": ("location.primary_lobe", "p.primary_lobe"),
    "depth": ("location.depth", "p.depth"), "side_note": ("location.laterality_validation.note", "s.note"), "side_consistent": ("location.laterality_validation.consistent", "s.consistent"),
    "enhancement": ("enhancement.present", "e.present"), "enhancement_pattern": ("enhancement.pattern", "e.pattern"), "strength": ("enhancement.strength", "coalesce(e.strength, 'None')"),
    "heterogeneity": ("enhancement.heterogeneity", "coalesce(e.heterogeneity, 'N/A')"),
    "shift_mm": ("mass_effect.midline_shift_mm", "m.shift_mm"), "shift_significant": ("mass_effect.shift_significant", "m.significant"), "shift_direction": ("mass_effect.shift_direction", "m.direction"),
    "herniation_risk": ("mass_effect.herniation_risk", "h.risk"), "mass_effect_score": ("mass_effect.mass_effect_score", "h.score"),
    "shape": ("morphology.shape", "lower(coalesce(a.shape_class, 'mass'))"), "sphericity": ("morphology.sphericity", "a.sphericity"), "elongation": ("morphology.elongation", "a.elongation"),
    "morphology": ("morphology.combined_description", "b.classification || ' contour with ' || lower(g.classification) || ' margins'"), "margin_sharpness": ("morphology.margin_sharpness", "g.sharpness"),
    "necrosis": ("necrosis.present", "n.present"), "necrosis_pattern": ("necrosis.pattern", "n.pattern"), "necrosis_percent": ("necrosis.percentage", "n.percent"), "necrosis_location": ("necrosis.location", "coalesce(n.location, 'N/A')"),
    "cystic": ("cystic_solid.classification", "c.classification"), "cystic_percent": ("cystic_solid.cystic_percentage", "c.cystic_percent"), "solid_percent": ("cystic_solid.solid_percentage", "c.solid_percent"),
    "lesions": ("multiplicity.lesion_count", "CAST(u.lesions AS INT)"), "single": ("multiplicity.is_single_lesion", "u.lesions = 1"), "pattern": ("multiplicity.distribution_pattern", "u.pattern"),
    "satellites": ("multiplicity.has_satellites", "u.satellites > 0"),
    "ventricles": ("normal_structures.ventricular_system.size", "w.size"), "ventricles_cm3": ("normal_structures.ventricular_system.volume_cm3", "w.total_cm3"),
    "hydrocephalus": ("normal_structures.ventricular_system.hydrocephalus", "w.hydrocephalus <> 'No hydrocephalus'"), "symmetry": ("normal_structures.ventricular_system.symmetry", "w.symmetry"),
    "differentiation": ("normal_structures.parenchyma.gray_white_differentiation", "t.differentiation"), "white_matter_disease": ("normal_structures.parenchyma.white_matter_disease", "t.white_matter_disease"),
    "parenchyma": ("normal_structures.parenchyma.overall", "t.overall"),
    "score": ("quality_metrics.segmentation_score", "z.score"), "grade": ("quality_metrics.segmentation_grade", "z.grade"),
    "artifact_severity": ("quality_metrics.artifacts.severity", "r.severity"), "artifact_impact": ("quality_metrics.artifacts.impact", "r.impact"),
    "differentials": (None, "CASE u.pattern " + " ".join(f"WHEN {_text(k)} THEN {_text(','.join(may))}" for k, (_, _, may) in S.PATTERNS.items()) + " ELSE '' END"),
    "qualities": (None, "k.qualities"), "warnings": (None, "coalesce(x.warnings, '')"), "caveats": (None, "coalesce(y.caveats, '')"),
}
_STEPS = {
    "p": "e11_location_report", "s": "e37_laterality_check", "e": "e05_enhancement", "m": "e07_midline_shift", "h": "e10_herniation", "a": "e21_e22_shape_classes", "b": "e23_border_regularity", "g": "e24_margin",
    "n": "e26_necrosis", "c": "e25_b24_cystic", "u": "e12_e17_multiplicity", "w": "e32_e33_ventricular_system", "t": "e34_parenchyma", "z": "e27_segmentation_quality", "r": "e29_artifacts",
}


def _twin(name: str) -> str:
    from cohortvox.plans.text_queries import ORACLE_SQL as texts

    return (Q.ORACLE_SQL | texts)[name]


@query("e36_summary_fields", "SELECT v.case_id, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in FIELDS.items()) + f""" FROM ({_twin('d03_volumes')}) v
LEFT JOIN (SELECT * FROM ({_twin('e12_d18_lesions')}) WHERE rank = 1) l USING (case_id)
""" + "\n".join(f"LEFT JOIN ({_twin(q)}) {a} USING (case_id)" for a, q in _STEPS.items()) + f"""
LEFT JOIN (SELECT case_id, string_agg(sequence || '=' || quality, ',' ORDER BY sequence) AS qualities FROM ({_twin('e28_image_quality')}) GROUP BY 1) k USING (case_id)
LEFT JOIN (SELECT case_id, string_agg(warning, ';' ORDER BY warning) AS warnings FROM ({_twin('e38_reliability_warnings')}) GROUP BY 1) x USING (case_id)
LEFT JOIN (SELECT case_id, string_agg(caveat, ';' ORDER BY caveat) AS caveats FROM ({_twin('e31_caveats')}) GROUP BY 1) y USING (case_id)""")
def e36_fields(spark, sf):
    """The nested summary of every case, flat: all steps of a case run together against their twins one by one."""
    s = summary(spark, sf)
    quality = F.array_sort(F.transform(F.map_entries("quality_metrics.sequence_quality"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    lists = {
        "differentials": F.array_join("differential_considerations", ","), "qualities": F.array_join(quality, ","),
        "warnings": F.array_join(F.array_sort(F.transform("measurement_reliability_warnings", lambda w: w["warning"])), ";"), "caveats": F.array_join(F.array_sort(F.coalesce("caveats", F.array().cast("array<string>"))), ";"),
    }
    return Q.rounded(s.select("case_id", *[F.coalesce(lists[n], F.lit("")).alias(n) if f is None else F.col(f).alias(n) for n, (f, _) in FIELDS.items()]))


def _names(f: DataFrame) -> tuple[Column, Column]:
    d = F.col("differentials")
    return F.get(d, F.lit(0)), F.coalesce(F.get(d, F.lit(1)), F.lit(""))


#: Slots that hold what belongs elsewhere: a diagnosis among the findings, certainty in the impression, concepts that another slot owns.
_MISPLACED = {
    "necrosis_sentence": "'Necrosis near the ' || lobes_formatted || '.'",
    "edema_sentence": "edema_degree || ' edema beside necrosis.'",
    "mass_effect_sentence": "CASE WHEN shift_significant THEN 'Shift likely ' || shift_mm || ' mm.' ELSE 'No shift, edema or hydrocephalus.' END",
    "parenchyma_sentence": "'Appearance of ' || split_part(differentials, ',', 1) || '.'",
    "impression_summary": "'Represents ' || split_part(differentials, ',', 1) || ', ' || split_part(differentials, ',', 2) || '.'",
}


@query("r26_misplaced_terms", f"WITH {FACTS}, mis AS (SELECT * REPLACE (CAST(CAST(shift_mm AS INT) AS VARCHAR) AS shift_mm) FROM f),\n{validated(' UNION ALL '.join(f'SELECT case_id, {_text(k)} AS slot, {v} AS content FROM mis' for k, v in _MISPLACED.items()))} SELECT case_id, slot, original, sanitized, array_to_string(violations, '; ') AS violations FROM chk WHERE len(violations) > 0")
def r26(spark, sf):
    """The validation log of every case's misplaced sentences."""
    f = P.facts(case_summaries(spark, sf)).repartition("case_id")  # small rows, long texts
    a, b = _names(f)
    text = {
        "necrosis_sentence": F.concat(F.lit("Necrosis near the "), "lobes_formatted", F.lit(".")),
        "edema_sentence": F.concat("edema_degree", F.lit(" edema beside necrosis.")),
        "mass_effect_sentence": F.when(F.col("shift_significant"), F.concat(F.lit("Shift likely "), F.bround("shift_mm").cast("int").cast("string"), F.lit(" mm."))).otherwise("No shift, edema or hydrocephalus."),
        "parenchyma_sentence": F.concat(F.lit("Appearance of "), a, F.lit(".")),
        "impression_summary": F.concat(F.lit("Represents "), a, F.lit(", "), b, F.lit(".")),
    }
    values = f.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), v.alias("content")) for k, v in text.items()])).alias("s")).select("case_id", "s.slot", "s.content")
    checked = P.validate(values, P.slot_specs(spark))
    return P.validation_log(checked)


_A = "CASE WHEN is_multifocal THEN 'Lesions ' ELSE 'A lesion ' END || 'suggestive of ' || split_part(differentials, ',', 1) || ', , in the ' || lobes_formatted || '. . Edema, edema and necrosis.' || chr(10) || chr(10) || chr(10) || chr(10) || '   Histopathology pending; no error.'"
_B = "'Definitely ' || split_part(differentials, ',', 2) || ' , never benign. . ' || CASE WHEN is_ring THEN 'Cancer is proven.' ELSE 'Not always malignant' END"
_GRAMMAR = {r",\s*\.": "Comma before period", r",\s*,": "Double comma", r"\.\s*\.": "Double period", r"\s{3,}": "Excessive whitespace"}


def _final_sql() -> str:
    """The final pass step by step over (case_id, a, b): sections, concepts, grammar, spaces, banned words."""
    drop = "list_reduce({terms}, lambda t, w: regexp_replace(t, '(?i)\\b' || regexp_escape(w) || '\\b', '', 'g'), {text})"
    found = lambda terms, c: f"list_filter({_quoted(terms)}, lambda w: contains(lower({c}), lower(w)))"
    steps = [
        "t0 AS (SELECT case_id, 'FINDINGS:' || chr(10) || a || chr(10) || 'IMPRESSION:' || chr(10) || b AS report, a, b FROM x)",
        f"t1 AS (SELECT *, {found(P.SECTION_TERMS['FINDINGS'], 'a')} AS ha, {found(P.SECTION_TERMS['IMPRESSION'], 'b')} AS hb FROM t0)",
        f"t2 AS (SELECT * REPLACE ({drop.format(terms='list_concat(ha, hb)', text='report')} AS report) FROM t1)",
        "t3 AS (SELECT *, list_concat(" + ", ".join(f"CASE WHEN len(regexp_extract_all(lower(report), {_text(k.replace('_', ' '))})) > 1 THEN ['Concept ''{k}'' appears ' || len(regexp_extract_all(lower(report), {_text(k.replace('_', ' '))})) || ' times'] ELSE [] END" for k in P.OWNERS) + ") AS hc FROM t2)",
    ]
    last = "t3"
    for k, (p, name) in enumerate(_GRAMMAR.items()):
        steps.append(f"g{k} AS (SELECT * REPLACE (regexp_replace(report, '{p}', ' ', 'g') AS report), CASE WHEN regexp_matches(report, '{p}') THEN ['Grammar issue: {name}'] ELSE [] END AS n{k} FROM {last})")
        last = f"g{k}"
    tidy = "report"
    for p, w in ((r"\n\s*\.\s*\n", "chr(10)"), (r"\s+,\s+", "' '"), (r" {2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
        tidy = f"regexp_replace({tidy}, '{p}', {w}, 'g')"
    steps += [
        f"t4 AS (SELECT * REPLACE ({tidy} AS report) FROM {last})",
        f"t5 AS (SELECT *, list_filter({_quoted(P.BANNED)}, lambda w: contains(safe, lower(w))) AS ban FROM (SELECT *, {masked('lower(report)')} AS safe FROM t4))",
        f"t6 AS (SELECT * REPLACE ({drop.format(terms='ban', text='report')} AS report) FROM t5)",
    ]
    note = lambda s: f"lambda w: 'Section ''{s}'' contains forbidden term: ''' || w || ''''"
    notes = f"list_concat(list_transform(ha, {note('FINDINGS')}), list_transform(hb, {note('IMPRESSION')}), hc, n0, n1, n2, n3, list_transform(ban, lambda w: 'Final check caught banned term: ''' || w || ''''))"
    return ",\n".join(steps) + f" SELECT case_id, report, array_to_string({notes}, '; ') AS notes FROM t6"


@query("r20_final_pass", f"WITH {FACTS}, x AS (SELECT case_id, {_A} AS a, {_B} AS b FROM f),\n{_final_sql()}")
def r20(spark, sf):
    """The last corrections of every case's report, each of which breaks the rules of its sections, concepts, grammar and words."""
    f = P.facts(case_summaries(spark, sf)).repartition("case_id")  # small rows, long texts
    one, two = _names(f)
    nl = F.lit("\n")
    a = F.concat(
        F.when(F.col("is_multifocal"), "Lesions ").otherwise("A lesion "), F.lit("suggestive of "), one, F.lit(", , in the "), "lobes_formatted", F.lit(". . Edema, edema and necrosis."), nl, nl, nl, nl,
        F.lit("   Histopathology pending; no error."),
    )
    b = F.concat(F.lit("Definitely "), two, F.lit(" , never benign. . "), F.when(F.col("is_ring"), "Cancer is proven.").otherwise("Not always malignant"))
    reports = f.select("case_id", F.concat(F.lit("FINDINGS:"), nl, a, nl, F.lit("IMPRESSION:"), nl, b).alias("report"))
    return P.final_pass(reports).select("case_id", "report", F.array_join("notes", "; ").alias("notes"))


_WORDS = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"
_DEFS = ", ".join(f"({_text(t)}, {_text(x)})" for t, x in R.DEFINITIONS)


@query("v02_definitions_top2", f"""WITH defs AS (SELECT * FROM (VALUES {_DEFS}) d(id, text)), tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, {_WORDS} AS token FROM defs) GROUP BY 1, 2),
ix AS (SELECT id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM tf), turns AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query, text FROM conversations),
q0 AS (SELECT query, token, count(*) AS n FROM (SELECT query, {_WORDS} AS token FROM turns) WHERE token IN (SELECT token FROM ix) GROUP BY 1, 2), qv AS (SELECT query, token, n / sqrt(sum(n * n) OVER (PARTITION BY query)) AS wq FROM q0),
sc AS (SELECT t.query, d.id, coalesce(sum(wq * w), 0.0) AS score FROM (SELECT DISTINCT query FROM turns) t CROSS JOIN defs d LEFT JOIN qv ON qv.query = t.query LEFT JOIN ix ON ix.id = d.id AND ix.token = qv.token GROUP BY 1, 2)
SELECT query, id, round(score, 6) AS score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS k FROM sc) WHERE k <= 2""")
def v02_definitions(spark, sf):
    """Every conversation turn as a question to the built-in definitions."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("q"), "text")
    docs = R.definitions(spark)
    return Q.rounded(R.term_top_k(R.term_index(docs, "id", "text"), docs, turns, "id", "q", "text").select("query", "id", "score", "rank"))


@query("c02_guarded_dice", f"SELECT * FROM ({Q.ORACLE_SQL['d10_compound_dice']}) WHERE case_id % 3 <> 0")
def c02_guarded(spark, sf):
    """Scores of two label volumes whose shapes differ in every third case: those have none."""
    g = grid(spark, sf)
    geometry, k = volumes(g), F.col("case_id")
    other = geometry.withColumn("nz", F.when(k % 3 == 0, F.col("nz") + 1).otherwise(F.col("nz")))
    cells = ["case_id", "x", "y", "z"]
    pairs = E.paired(g.select(*cells, F.col("seg_pred").alias("label")), g.select(*cells, F.col("seg").alias("label")), other, geometry)
    return Q.rounded(E.compound_scores(pairs, "pred", "gt"))


def _fixed(x: str, digits: int) -> str:
    """A number as printed: the shortest digits of the double, rounded half up."""
    return f"CAST(CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DECIMAL(20, {digits})) AS VARCHAR)"


def _worded(table: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + " END"


def _lines(*parts: str) -> str:
    """SQL of a text: the lines that are not null."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL), chr(10))"


def _when(cond: str, line: str) -> str:
    return f"CASE WHEN {cond} THEN {line} END"


_LOBES_REST = "array_to_string(list_filter(string_split(p.lobes, ','), lambda v: v <> '' AND replace(v, ' ', '_') <> p.primary_lobe), ', ')"
_MASS = _lines(
    "'MASS EFFECT ANALYSIS:'", "''", "'Anatomical Location:'", "'  - Laterality: ' || p.laterality",
    f"'  - Primary lobe: ' || upper(left(p.primary_lobe, 1)) || substr(p.primary_lobe, 2) || ' (' || {_fixed('p.primary_percent', 0)} || '%)'",
    _when("len(string_split(p.lobes, ',')) > 1", f"'  - Additional involvement: ' || {_LOBES_REST}"), "'  - Depth: ' || p.depth",
    _when("p.gyri NOT IN ('', 'gyral localization not determined')", "'  - Gyri (estimated): ' || replace(p.gyri, ',', ', ')"),
    "''", _when("m.significant", f"'Midline Shift: ' || m.severity || ' (' || {_fixed('m.shift_mm', 1)} || ' mm)'"), _when("m.significant", "'  - Direction: ' || m.direction"),
    _when("NOT m.significant", "'Midline Shift: None'"), _when("NOT m.significant", "'  - No significant midline shift detected'"), "'  - Tumor hemisphere: ' || m.tumor_hemisphere",
    "''", "'Ventricular System: ' || o.severity", _when("o.asymmetry > 0.15", "'  - Compressed side: ' || o.compressed_side"), _when("o.asymmetry > 0.15", f"'  - Asymmetry ratio: ' || {_fixed('o.asymmetry', 2)}"),
    _when("o.distance_mm > 0", f"'  - Tumor-ventricle distance: ' || {_fixed('o.distance_mm', 1)} || ' mm'"),
    "''", "'Sulcal Effacement: ' || f.severity", "''", "'Herniation Risk Assessment: ' || h.risk", f"'  - Mass effect score: ' || {_fixed('h.score', 1)} || '/7'",
    "array_to_string(list_transform(string_split(h.signs, '; '), lambda v: '  - ' || v), chr(10))",
)
_MORPH = _lines(
    "'TUMOR MORPHOLOGY AND MARGINS:'", "''", "'Shape: ' || a.shape_class", f"'  - Volume: ' || {_fixed('a.volume_cm3', 2)} || ' cm³'", f"'  - Surface area: ' || {_fixed('a.surface_mm2', 0)} || ' mm²'",
    f"'  - Sphericity: ' || {_fixed('a.sphericity', 2)} || ' (' || lower(a.shape_class) || ')'", f"'  - Elongation: ' || {_fixed('a.elongation', 2)} || ' (' || lower(a.elongation_class) || ')'",
    "''", "'Contour Shape: ' || b.classification", "'  (Measures outer surface smoothness, not intensity transition)'", f"'  ' || {_worded(W.BORDER, 'b.classification')}",
    "''", "'Margin Transition: ' || g.classification", "'  (Measures tumor-brain intensity demarcation)'", f"'  ' || {_worded(W.MARGIN, 'g.classification')}",
    "''", "'Morphology Summary: ' || b.classification || ' contour with ' || lower(g.classification) || ' margins'",
    "''", "'Necrosis: ' || n.pattern", _when("n.present", f"'  - Volume: ' || {_fixed('n.necrosis_cm3', 2)} || ' cm³ (' || {_fixed('n.percent', 0)} || '% of tumor)'"), _when("n.present", "'  - Location: ' || n.location"),
    f"'  ' || replace({_worded(W.NECROSIS, 'n.pattern')}, '%.0f%%', {_fixed('n.percent', 0)} || '%')",
    "''", "'Cystic/Solid: ' || c.classification", f"'  - Solid: ' || {_fixed('c.solid_percent', 0)} || '%, Cystic: ' || {_fixed('c.cystic_percent', 0)} || '%'", f"'  ' || {_worded(W.CYSTIC, 'c.classification')}",
    "'  - T2 signal: ' || c.t2_homogeneity", "'  - FLAIR: ' || c.flair_suppression",
)
_AROUND = "CASE WHEN t.pv IS NULL THEN 'Periventricular region could not be assessed' WHEN t.pv > 1.3 THEN 'FLAIR hyperintensities in periventricular white matter, may represent chronic small vessel disease' WHEN t.pv > 1.15 THEN 'Mild periventricular FLAIR signal changes' ELSE 'No significant periventricular white matter changes' END"
_STRUCT = _lines(
    "'NORMAL STRUCTURES ASSESSMENT:'", "''", "'Ventricular System:'", f"'  - Size: ' || w.size || ' (VBR: ' || {_fixed('w.vbr', 1)} || '%)'",
    f"'  - Volume: ' || {_fixed('w.total_cm3', 1)} || ' cm³ (L: ' || {_fixed('w.left_cm3', 1)} || ', R: ' || {_fixed('w.right_cm3', 1)} || ')'", "'  - Symmetry: ' || w.symmetry", "'  - ' || w.hydrocephalus",
    _when("w.obstruction > 0.1", "'  - ⚠ Tumor adjacent to ventricular system'"),
    "''", "'Brain Parenchyma:'", "'  - Gray-white differentiation: ' || t.differentiation", f"'    ' || {_worded(W.GREY_WHITE, 't.differentiation')}", f"'  - Periventricular white matter: ' || {_AROUND}", "'  - Overall: ' || t.overall",
    "''", "'Major Vessels (Limited Assessment):'", "'  - Flow voids: ' || i.flow_voids", "'  - Vascular involvement: ' || i.involvement", "'  Note: Limited assessment on structural sequences'",
)
_TEXT_STEPS = {
    "p": "e11_location_report", "m": "e07_midline_shift", "o": "e08_ventricular_compression", "f": "e09_sulcal_effacement", "h": "e10_herniation_report", "a": "e21_e22_shape_classes", "b": "e23_border_regularity",
    "g": "e24_margin", "n": "e26_necrosis", "c": "e25_b24_cystic", "w": "e32_e33_ventricular_system", "t": "e34_parenchyma", "i": "e35_vessels",
}


@query("e39_three_step_texts", f"SELECT v.case_id, {_MASS} AS mass_effect, {_MORPH} AS morphology, {_STRUCT} AS structures FROM ({_twin('d03_volumes')}) v\n" + "\n".join(f"LEFT JOIN ({_twin(q)}) {a} USING (case_id)" for a, q in _TEXT_STEPS.items()))
def e39_texts(spark, sf):
    """The texts of mass effect, morphology and structures, line by line."""
    return ST.step_texts(found(spark, sf)).select("case_id", "mass_effect", "morphology", "structures")
