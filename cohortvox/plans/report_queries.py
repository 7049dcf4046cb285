"""Registered queries over report facts, sentences, rules and sections, and their SQL twins.

Each order gives one case summary (``CASES``), with null and empty values among
them, so that every branch of the facts and sentences is met at any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortvox.plans import report as P, summary as S
from cohortvox.plans.cohort_queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return add


def _pick(key: str, *values: str | None) -> str:
    """The value at a number's remainder; None is null."""
    quoted = ["NULL" if v is None else f"'{v}'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


#: Runs in Spark SQL and in DuckDB.
CASES = f"""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 4 AS INT) END AS lesion_count,
 {_pick('o_orderkey', 'Solitary', 'Primary with satellites', 'Regional multifocal', 'Distant multifocal', 'Diffuse/scattered', 'Multicentric', None)} AS pattern,
 {_pick('o_custkey', 'left', 'right', 'bilateral', 'left-predominant', None)} AS hemisphere,
 {_pick('o_orderkey', 'frontal', 'parietal', 'temporal', 'occipital', None)} AS primary_lobe,
 {_pick('o_custkey', '', 'frontal', 'frontal,parietal', 'frontal,temporal,occipital', None, 'deep structures')} AS lobes,
 {_pick('o_orderkey', 'Deep (periventricular/central)', 'Subcortical', 'Cortical/Superficial', 'Periventricular', None, 'N/A')} AS depth,
 CASE WHEN o_custkey % 13 <> 0 THEN CAST(o_custkey % 97 AS DOUBLE) / 2 END AS diameter,
 CASE WHEN o_custkey % 17 <> 0 THEN CAST(o_custkey % 60 AS DOUBLE) END AS volume, o_totalprice / 10000 AS edema,
 CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 = 0 END AS enhancing, {_pick('o_custkey', 'Ring-enhancing', 'Solid/nodular enhancing', None)} AS enhancement,
 {_pick('o_orderkey', 'Markedly heterogeneous', 'Homogeneous', 'Heterogeneous', None)} AS heterogeneity,
 CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 3 <> 0 END AS necrotic, CASE WHEN o_custkey % 19 <> 0 THEN CAST(o_custkey % 101 AS DOUBLE) END AS necrosis,
 CASE WHEN o_custkey % 23 <> 0 THEN CAST(o_custkey % 43 AS DOUBLE) / 8 END AS shift, {_pick('o_orderkey', 'Left to right', 'Right to left', '', None)} AS direction,
 {_pick('o_custkey', 'Ovoid', 'Irregular', 'Spherical/round', 'mass', None)} AS shape,
 {_pick('o_orderkey', 'Normal', 'Mildly prominent', None)} AS ventricles, {_pick('o_custkey', 'Symmetric', 'Asymmetric (left larger)', None)} AS symmetry,
 CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 5 = 0 END AS hydrocephalus,
 {_pick('o_custkey', 'Normal', 'Abnormal findings present', 'Unable to assess', None)} AS parenchyma, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 7 = 0 END AS disease,
 {_pick('o_orderkey', 'T1,T1ce,T2,FLAIR', 'T1', 'T1,T2', '', None, 'T1ce,DWI')} AS sequences, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 2 = 0 END AS contrast,
 {_pick('o_custkey', '<not provided>', 'MRI of last year', None)} AS prior,
 {_pick('o_orderkey', 'Metastatic disease,Multicentric glioma,CNS lymphoma,Multifocal infection', 'Abscess', '', None, 'Glioblastoma,Regional metastases,Gliomatosis')} AS differentials
 FROM orders"""


def case_rows(spark, sf) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return spark.sql(CASES.replace("FROM orders", "FROM {orders}"), orders=orders)


def _list(name: str) -> Column:
    c = F.col(name)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def case_summaries(spark, sf) -> DataFrame:
    """The cases as nested summaries."""
    c = F.col
    rows = case_rows(spark, sf).repartition("case_id")  # every value is computed once, and a compact file is spread over all tasks
    return rows.select(
        "case_id", F.struct(c("prior").alias("relevant_prior_imaging")).alias("patient_info"),
        F.struct(_list("sequences").alias("sequences_performed"), c("contrast").alias("contrast_administered")).alias("technique"),
        F.struct(c("diameter").alias("max_diameter_mm"), c("volume").alias("volume_cm3"), c("edema").alias("edema_volume_cm3")).alias("tumor_characteristics"),
        F.struct("hemisphere", "primary_lobe", _list("lobes").alias("involved_lobes"), "depth").alias("location"),
        F.struct(c("enhancing").alias("present"), c("enhancement").alias("pattern"), "heterogeneity").alias("enhancement"),
        F.struct(c("shift").alias("midline_shift_mm"), c("direction").alias("shift_direction")).alias("mass_effect"), F.struct("shape").alias("morphology"),
        F.struct(c("necrotic").alias("present"), c("necrosis").alias("percentage")).alias("necrosis"),
        F.struct("lesion_count", c("pattern").alias("distribution_pattern")).alias("multiplicity"),
        F.struct(F.struct(c("ventricles").alias("size"), "symmetry", "hydrocephalus").alias("ventricular_system"), F.struct(c("parenchyma").alias("overall"), c("disease").alias("white_matter_disease")).alias("parenchyma")).alias("normal_structures"),
        _list("differentials").alias("differential_considerations"),
    )


_LOBES = "CASE WHEN lobes IS NULL OR lobes = '' THEN [] ELSE string_split(lobes, ',') END"
FACTS = f"""s AS ({CASES}),
f AS (SELECT case_id, coalesce(lesion_count, 1) AS lesion_count, coalesce(lesion_count, 1) > 1 AS is_multifocal,
 CASE WHEN coalesce(lesion_count, 1) = 1 THEN 'focal' WHEN regexp_matches(lower(coalesce(pattern, '')), 'distant|multicentric') THEN 'multifocal or multicentric' ELSE 'multifocal' END AS distribution,
 coalesce(hemisphere, 'unknown') AS hemisphere, coalesce(primary_lobe, 'unknown') AS primary_lobe,
 coalesce(hemisphere, 'unknown') || ' ' || CASE len(l) WHEN 0 THEN coalesce(primary_lobe, 'unknown') || ' lobe' WHEN 1 THEN l[1] || ' lobe' WHEN 2 THEN l[1] || ' and ' || l[2] || ' lobes' ELSE l[1] || ', ' || l[2] || ', and ' || l[3] || ' lobes' END AS lobes_formatted,
 CASE WHEN contains(lower(depth), 'subcortical') THEN 'subcortical ' WHEN contains(lower(depth), 'deep') THEN 'deep ' WHEN contains(lower(depth), 'cortical') THEN 'cortical and subcortical ' WHEN contains(lower(depth), 'periventricular') THEN 'periventricular ' ELSE '' END AS depth_prefix,
 round_even(CAST(coalesce(diameter, 0) AS DOUBLE) / 10 * 2, 0) / 2 AS size_cm, coalesce(enhancing, false) AS enhancement_present, lower(coalesce(heterogeneity, '')) AS heterogeneity,
 contains(lower(coalesce(enhancement, '')), 'ring') AS is_ring, coalesce(necrotic, false) AS necrosis_present,
 CASE WHEN NOT coalesce(necrotic, false) OR coalesce(necrosis, 0) / 100 < 0.01 THEN 'none' WHEN necrosis / 100 < 0.1 THEN 'minimal' WHEN necrosis / 100 < 0.3 THEN 'moderate' WHEN necrosis / 100 < 1 THEN 'extensive' ELSE 'minimal' END AS necrosis_degree,
 CASE WHEN coalesce(volume, 0) > 0 THEN least(edema / volume, 1.0) ELSE 0.0 END AS edema_ratio,
 CASE WHEN edema < 5 THEN 'Minimal' WHEN edema < 15 THEN 'Moderate' WHEN edema < 30 THEN 'Significant' ELSE 'Extensive' END AS edema_degree,
 coalesce(shift, 0) AS shift_mm, coalesce(shift >= 2, false) AS shift_significant, coalesce(direction, '') AS shift_direction, lower(coalesce(shape, 'mass')) AS shape,
 contains(lower(coalesce(ventricles, 'Normal')), 'normal') AS ventricles_normal, NOT contains(lower(coalesce(symmetry, 'Symmetric')), 'asymmetric') AS ventricles_symmetric, coalesce(hydrocephalus, false) AS hydrocephalus,
 contains(lower(coalesce(parenchyma, 'Normal')), 'normal') AS parenchyma_normal, coalesce(disease, false) AS white_matter_disease, coalesce(sequences, '') AS sequences,
 coalesce(contrast, false) AS contrast_given, coalesce(prior <> '<not provided>', false) AS prior_imaging,
 CASE WHEN coalesce(differentials, '') = '' THEN 'high-grade glioma,metastasis,lymphoma' ELSE differentials END AS differentials
 FROM (SELECT *, {_LOBES} AS l FROM s))"""


@query("r01_r10_facts", f"WITH {FACTS} SELECT * REPLACE (round(size_cm, 6) AS size_cm, round(shift_mm, 6) AS shift_mm) FROM f")
def r01(spark, sf):
    f = P.facts(case_summaries(spark, sf)).withColumn("sequences", F.concat_ws(",", "sequences")).withColumn("differentials", F.concat_ws(",", "differentials"))
    whole = F.col("edema_ratio")  # a quotient of the same doubles on both sides, compared as it is
    return rounded(f.withColumn("__ratio", F.struct(whole))).withColumn("edema_ratio", F.col("__ratio.edema_ratio")).drop("__ratio")


def _oxford(items: str, comma: str = "") -> str:
    """At most four items."""
    return f"CASE len({items}) WHEN 0 THEN '' WHEN 1 THEN {items}[1] WHEN 2 THEN {items}[1] || '{comma} and ' || {items}[2] ELSE array_to_string({items}[1:len({items}) - 1], ', ') || ', and ' || {items}[len({items})] END"


_KIND = "CASE WHEN contains(d, 'glioma') OR contains(d, 'glioblastoma') THEN 'high-grade glioma' WHEN contains(d, 'metast') THEN 'metastatic disease' WHEN contains(d, 'lymphoma') THEN 'primary CNS lymphoma' ELSE d END"
_NAMED = "CASE upper(q) WHEN 'T1' THEN 'T1-weighted' WHEN 'T1CE' THEN 'post-contrast T1-weighted' WHEN 'T2' THEN 'T2-weighted' WHEN 'FLAIR' THEN 'FLAIR' ELSE q END"
_SENTENCES = {
    "patient_id": "CAST(case_id AS VARCHAR)",
    "exam_date": "'January 31, 2024'",
    "clinical_indication": "'Clinical indication not provided.'",
    "sequences_list": f"CASE WHEN len(q) = 0 THEN 'standard sequences' ELSE {_oxford('q')} END",
    "contrast_sentence": "CASE WHEN contrast_given THEN 'Post-contrast T1-weighted imaging was obtained following intravenous gadolinium administration.' ELSE 'No intravenous contrast was administered.' END",
    "comparison": "CASE WHEN prior_imaging THEN 'Compared to prior examination.' ELSE 'No prior imaging available for comparison.' END",
    "lesion_count_sentence": "CASE lesion_count WHEN 1 THEN 'A single enhancing lesion is identified within the ' || hemisphere || ' cerebral hemisphere.' WHEN 2 THEN 'Two spatially separate enhancing lesions are identified within the ' || hemisphere || ' cerebral hemisphere.' ELSE 'Multiple enhancing lesions (' || lesion_count || ') are identified with a ' || distribution || ' distribution.' END",
    "dominant_lesion_sentence": "'The dominant lesion is ' || CASE WHEN regexp_matches(CASE WHEN depth_prefix <> '' THEN depth_prefix ELSE sh END, '^[aeiou]') THEN 'an' ELSE 'a' END || ' ' || depth_prefix || sh || 'mass located in the ' || lobes_formatted || ', measuring approximately ' || sz || ' cm in maximum diameter.'",
    "enhancement_sentence": "CASE WHEN NOT enhancement_present THEN 'No abnormal enhancement is identified.' WHEN is_ring AND mixed THEN 'The lesion demonstrates heterogeneous ring enhancement.' WHEN is_ring THEN 'The lesion demonstrates ring enhancement with a non-enhancing central component.' WHEN mixed THEN 'The lesion demonstrates heterogeneous enhancement following contrast administration.' ELSE 'The lesion demonstrates homogeneous enhancement following contrast administration.' END",
    "necrosis_sentence": "CASE WHEN NOT necrosis_present THEN 'No central necrosis is identified.' WHEN necrosis_degree = 'minimal' THEN 'A small central necrotic component is identified.' WHEN necrosis_degree = 'extensive' THEN 'A large area of central necrosis is present.' ELSE 'Central necrosis is present within the lesion.' END",
    "edema_sentence": "edema_degree || ' surrounding T2/FLAIR hyperintensity is present' || CASE WHEN edema_degree IN ('Extensive', 'Significant') THEN ', representing vasogenic edema.' ELSE '.' END",
    "mass_effect_sentence": "CASE WHEN NOT shift_significant THEN 'No significant midline shift is identified. No evidence of herniation.' ELSE 'There is approximately ' || CAST(round(CAST(shift_mm AS DOUBLE), 1) AS VARCHAR) || ' mm of midline shift' || CASE WHEN shift_direction <> '' THEN ' to the ' || shift_direction ELSE '' END || '. No evidence of herniation.' END",
    "ventricles_sentence": "CASE WHEN hydrocephalus THEN 'The ventricular system demonstrates ventriculomegaly.' WHEN NOT ventricles_symmetric THEN 'The ventricular system is normal in size with mild asymmetry of the lateral ventricles.' ELSE 'The ventricular system is normal in size and configuration.' END",
    "parenchyma_sentence": "CASE WHEN white_matter_disease THEN 'Background white matter changes are noted. Gray-white matter differentiation is otherwise preserved.' WHEN parenchyma_normal THEN 'The remaining brain parenchyma demonstrates preserved gray-white matter differentiation.' ELSE 'The remaining brain parenchyma appears unremarkable.' END",
    "impression_summary": "CASE WHEN is_multifocal AND is_ring THEN 'Multifocal ring-enhancing masses in the ' || hemisphere || ' cerebral hemisphere, largest measuring approximately ' || sz || ' cm, suspicious for high-grade neoplastic process.' WHEN is_multifocal THEN 'Multifocal enhancing masses in the ' || hemisphere || ' cerebral hemisphere, imaging features suspicious for neoplastic process.' WHEN is_ring THEN 'Ring-enhancing mass in the ' || hemisphere || ' ' || primary_lobe || ' lobe, measuring approximately ' || sz || ' cm, suspicious for high-grade neoplastic process.' ELSE 'Enhancing mass in the ' || hemisphere || ' ' || primary_lobe || ' lobe, measuring approximately ' || sz || ' cm, with imaging features concerning for neoplastic process.' END",
    "impression_differential": f"'Differential diagnosis includes ' || {_oxford('dd', ',')} || '. Clinical and histopathologic correlation recommended.'",
}
SENTENCES = f"""{FACTS},
v AS (SELECT case_id, {', '.join(f'{e} AS {k}' for k, e in _SENTENCES.items())} FROM (SELECT *,
 CASE WHEN shape NOT IN ('', 'mass') THEN shape || ' ' ELSE '' END AS sh, contains(heterogeneity, 'heterogeneous') AS mixed, CAST(CAST(size_cm AS DOUBLE) AS VARCHAR) AS sz,
 list_transform(CASE WHEN sequences = '' THEN [] ELSE string_split(sequences, ',') END, lambda q: {_NAMED}) AS q, d3 AS dd
 FROM (SELECT *, list_filter(list_transform(range(1, len(k3) + 1), lambda i: CASE WHEN list_position(k3, k3[i]) = i THEN k3[i] END), lambda x: x IS NOT NULL) AS d3
  FROM (SELECT *, list_transform(list_transform(string_split(differentials, ',')[1:3], lambda x: lower(x)), lambda d: {_KIND}) AS k3 FROM f))))"""


@query("r11_t03_slot_values", f"WITH {SENTENCES} " + " UNION ALL ".join(f"SELECT case_id, '{k}' AS slot, {k} AS content FROM v" for k in _SENTENCES))
def r11(spark, sf):
    return P.slot_values(P.facts(case_summaries(spark, sf)), F.lit("January 31, 2024"))


def slot_texts(spark, sf) -> DataFrame:
    return P.slot_texts(P.facts(case_summaries(spark, sf)), F.lit("January 31, 2024"))


def filled_reports(spark, sf) -> DataFrame:
    return P.fill_whole(slot_texts(spark, sf))


def _filled() -> str:
    parts, rest = [], P.TEMPLATE
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += ["'" + text.replace("'", "''") + "'", name]
    return " || ".join([*parts, "'" + rest.replace("'", "''") + "'"])


REPORTS = f"{SENTENCES},\nr AS (SELECT case_id, {_filled()} AS report FROM v)"


@query("r19_filled_reports", f"WITH {REPORTS} SELECT case_id, report FROM r")
def r19(spark, sf):
    return filled_reports(spark, sf)


def _section(name: str) -> str:
    """From a marker to the next one in the template's order."""
    order = ("TECHNIQUE", "COMPARISON", "FINDINGS", "IMPRESSION")
    after = order[order.index(name) + 1 :][:1]
    start = f"strpos(report, '{name}:') + {len(name) + 1}"
    end = f"strpos(report, '{after[0]}:')" if after else "length(report) + 1"
    return f"SELECT case_id, '{name}' AS section, trim(substr(report, {start}, {end} - ({start})), ' ' || chr(10) || chr(9)) AS text FROM r"


@query("a16_report_sections", f"WITH {REPORTS} " + " UNION ALL ".join(_section(m) for m in P.MARKERS))
def a16(spark, sf):
    return filled_reports(spark, sf).select("case_id", F.explode(P.sections(F.col("report"))).alias("section", "text"))


@query("a17_impression_items", f"WITH {SENTENCES} SELECT case_id, impression_summary || ' | ' || impression_differential AS items FROM v")
def a17(spark, sf):
    return filled_reports(spark, sf).select("case_id", F.array_join(P.impression_items(F.col("report")), " | ").alias("items"))


@query("a18_flat_metrics", f"WITH s AS ({CASES}) SELECT case_id, coalesce(volume, 0) AS volume_cm3, coalesce(diameter, 0) AS max_diameter_mm, round(coalesce(shift, 0), 6) AS midline_shift_mm, coalesce(lesion_count, 1) AS lesion_count, coalesce(hemisphere, 'unknown') AS hemisphere, coalesce(primary_lobe, 'unknown') AS primary_lobe, coalesce(enhancement, 'unknown') AS enhancement_pattern, coalesce(necrosis, 0) AS necrosis_percent, CAST(NULL AS DOUBLE) AS dice FROM s")
def a18(spark, sf):
    return rounded(S.flat_metrics(case_summaries(spark, sf)))


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::VARCHAR[]"


def masked(low: str) -> str:
    """Lower-case text with the first occurrence of each allowed compound blanked."""
    out = low
    for w in P.COMPOUNDS:
        at = f"strpos({low}, '{w}')"
        out = f"CASE WHEN {at} > 0 THEN substr({out}, 1, {at} - 1) || repeat(chr(1), {len(w)}) || substr({out}, {at} + {len(w)}) ELSE {out} END"
    return out


def _specs() -> str:
    rows = []
    for k, (name, s) in enumerate(P.SLOTS.items()):
        section, most, fallback, forbidden, _ = s or (None, None, None, [], {})
        text = lambda x: "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"
        rows.append(f"('{name}', {k}, {text(section)}, {most if most else 'NULL'}, {text(fallback)}, {_quoted(forbidden)}, {_quoted(P.SECTION_TERMS.get(section, []))})")
    return "spec(slot, place, section, most, fallback, forbidden, terms) AS (VALUES " + ", ".join(rows) + ")"


_HELD = "list_filter({0}, lambda w: contains(low, lower(w)))"
_SAID = {c: f"state IS NULL AND (contains(low, '{c.replace('_', ' ')}') OR contains(low, '{c}'))" for c in P.OWNERS}
_CONCEPTS = ", ".join(
    f"CASE WHEN {_SAID[c]} AND slot <> '{o}' AND min(CASE WHEN {_SAID[c]} AND slot = '{o}' THEN place END) OVER (PARTITION BY case_id) < place THEN 'Concept ''{c}'' already reported by ''{o}''' END" for c, o in P.OWNERS.items()
)


def validated(values: str) -> str:
    """CTEs that end in ``chk`` (case_id, slot, place, original, sanitized, violations as a list) over a table (case_id, slot, content)."""
    return f"""{_specs()},
lo AS (SELECT x.*, spec.* EXCLUDE (slot), lower(content) AS low, {masked('lower(content)')} AS safe FROM ({values}) x LEFT JOIN spec ON spec.slot = x.slot),
hits AS (SELECT *, coalesce(list_filter({_quoted(P.BANNED)}, lambda w: contains(safe, lower(w))), [])[1:1] AS ban, coalesce({_HELD.format("coalesce(terms, [])")}, []) AS sec, coalesce({_HELD.format("coalesce(forbidden, [])")}, [])[1:1] AS own FROM lo),
st AS (SELECT *, CASE WHEN len(ban) > 0 THEN '[BANNED]' WHEN len(sec) > 0 THEN '[SECTION_VIOLATION]' WHEN len(own) > 0 THEN '[SLOT_VIOLATION]' END AS state FROM hits),
chk AS (SELECT case_id, slot, place, content AS original, CASE WHEN state IS NOT NULL AND coalesce(fallback, '') <> '' THEN fallback WHEN state IS NOT NULL THEN state WHEN length(content) > most THEN substr(content, 1, most - 3) || '...' ELSE content END AS sanitized,
 list_filter(list_concat(list_transform(ban, lambda b: 'Global banned: ''' || b || ''''), CASE WHEN len(ban) > 0 THEN [] ELSE list_transform(sec, lambda t: 'Section ''' || section || ''' forbidden term: ''' || t || '''') END,
  CASE WHEN state = '[SLOT_VIOLATION]' THEN list_transform(own, lambda t: 'Slot forbidden: ''' || t || '''') ELSE [] END,
  [CASE WHEN state IS NULL AND length(content) > most THEN 'Exceeds max length (' || length(content) || ' > ' || most || ')' END, {_CONCEPTS}, CASE WHEN state IS NOT NULL AND coalesce(fallback, '') <> '' THEN 'Used fallback due to validation failure' END]), lambda x: x IS NOT NULL) AS violations FROM st)"""


@query("r14_r17_validated_sentences", f"WITH {SENTENCES},\n{validated(' UNION ALL '.join(f'SELECT case_id, {chr(39)}{k}{chr(39)} AS slot, {k} AS content FROM v' for k in _SENTENCES))} SELECT case_id, slot, sanitized, array_to_string(violations, '; ') AS violations FROM chk")
def r17(spark, sf):
    v = P.validate_whole(slot_texts(spark, sf), P.slot_specs(spark))
    return v.select("case_id", "slot", "sanitized", F.array_join("violations", "; ").alias("violations"))


@query("r26_validation_log", f"WITH {SENTENCES},\n{validated(' UNION ALL '.join(f'SELECT case_id, {chr(39)}{k}{chr(39)} AS slot, {k} AS content FROM v' for k in _SENTENCES))} SELECT case_id, slot, original, sanitized, array_to_string(violations, '; ') AS violations FROM chk WHERE len(violations) > 0")
def r26(spark, sf):
    return P.report_bundle(case_summaries(spark, sf), "2024-01-31")[1]
