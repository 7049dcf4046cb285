"""Report text from summaries under fixed rules, with a log of every correction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortvox.functions.text import article, half_centimetres, oxford
from cohortvox.plans.summary import NOT_GIVEN

# Fixed values of the rules: terms, sections, fallbacks and lengths.
SECTION_TERMS = {
    "FINDINGS": [
        "concern", "concerning", "suspicious", "suspicious for", "suggestive", "suggestive of", "raises concern", "raising concern",
        "neoplasm", "glioblastoma", "tumor", "cancer", "disease", "differential", "likely", "probable", "favor", "favoring",
        "consistent with", "diagnostic of", "compatible with",
    ],
    "IMPRESSION": ["diagnostic of", "definitive for", "definitely", "certainly", "100%", "always", "never"],
}
BANNED = [
    "microscopic", "definitive", "histologic", "histological", "pathologic", "pathological", "biopsy-proven", "confirmed", "definite",
    "certainly", "definitely", "proven", "diagnostic of", "benign", "malignant", "cancer", "carcinoma", "sarcoma", "malpractice", "error",
    "mistake", "missed", "overlooked", "looks like", "seems to be", "probably", "maybe", "I think", "in my opinion", "appears to possibly",
]
COMPOUNDS = ["histopathologic", "histopathological", "histopathology"]
OWNERS = {
    "necrosis": "necrosis_sentence", "edema": "edema_sentence", "mass_effect": "mass_effect_sentence", "enhancement_center": "enhancement_sentence",
    "ring_enhancement": "enhancement_sentence", "midline_shift": "mass_effect_sentence", "herniation": "mass_effect_sentence", "hydrocephalus": "ventricles_sentence",
}
#: Slot: (section, longest text, fallback, forbidden terms, allowed values); the order is the report's.
SLOTS = {
    "patient_id": None,
    "exam_date": None,
    "clinical_indication": ("CLINICAL_INDICATION", 500, "Clinical indication not provided.", [], {}),
    "sequences_list": ("TECHNIQUE", 200, "standard sequences", [], {}),
    "contrast_sentence": ("TECHNIQUE", 150, "Post-contrast T1-weighted imaging was obtained following intravenous gadolinium administration.", [], {}),
    "comparison": ("COMPARISON", 200, "No prior imaging available for comparison.", [], {}),
    "lesion_count_sentence": ("FINDINGS", 200, "An enhancing lesion is identified within the cerebral hemisphere.", ["tumor", "cancer", "neoplasm", "malignant", "glioblastoma", "concern", "suspicious", "suggestive", "disease"], {"hemisphere": ["right", "left", "bilateral"], "distribution": ["multifocal", "multicentric", "scattered", "clustered"]}),
    "dominant_lesion_sentence": ("FINDINGS", 250, "A mass is identified within the cerebral hemisphere.", ["microscopic", "invasive", "definitive", "tumor", "cancer", "neoplasm", "malignant", "glioblastoma", "metastasis", "concern", "suspicious", "suggestive", "disease"], {"depth": ["", "subcortical ", "deep ", "cortical and subcortical ", "periventricular "], "shape": ["", "ovoid ", "irregular ", "round ", "lobulated "], "hemisphere": ["right", "left", "bilateral", "midline"]}),
    "enhancement_sentence": ("FINDINGS", 200, "Enhancement is noted following contrast administration.", ["tumor", "cancer", "neoplasm", "malignant", "glioblastoma", "aggressive", "definitive", "necrosis", "necrotic", "concern", "suspicious", "suggestive", "disease"], {"pattern": ["ring enhancement", "homogeneous enhancement", "heterogeneous enhancement", "nodular enhancement"]}),
    "necrosis_sentence": ("FINDINGS", 150, "Central signal abnormality is noted within the lesion.", ["tumor", "cancer", "glioblastoma", "malignant", "percentage", "%", "microscopic", "concern", "suspicious", "suggestive", "disease"], {}),
    "edema_sentence": ("FINDINGS", 150, "Surrounding T2/FLAIR hyperintensity is present.", ["cm³", "cm3", "cubic", "volume", "ml", "mL", "tumor", "cancer", "neoplasm", "concern", "suspicious", "suggestive", "disease", "consistent with"], {"edema_degree": ["Minimal", "Moderate", "Significant", "Extensive"]}),
    "mass_effect_sentence": ("FINDINGS", 200, "No significant midline shift is identified. No evidence of herniation.", ["risk", "probability", "likely", "percent", "%", "tumor", "cancer", "dangerous", "concern", "suspicious", "suggestive", "disease"], {"direction": ["left", "right"]}),
    "ventricles_sentence": ("FINDINGS", 150, "The ventricular system is normal in size and configuration.", ["tumor", "cancer", "mass", "concern", "suspicious", "suggestive", "disease"], {}),
    "parenchyma_sentence": ("FINDINGS", 200, "The remaining brain parenchyma appears unremarkable.", ["tumor", "cancer", "neoplasm", "metastasis", "concern", "suspicious", "suggestive", "disease"], {}),
    "impression_summary": ("IMPRESSION", 300, "Enhancing mass identified, suspicious for neoplastic process. Clinical correlation recommended.", ["definitive", "definitely", "certainly", "proven", "microscopic", "invasive", "diagnostic of", "consistent with", "confirms", "represents", "is a"], {"hemisphere": ["right", "left", "bilateral"]}),
    "impression_differential": ("IMPRESSION", 250, "Differential diagnosis includes high-grade glioma, metastasis, and lymphoma. Histopathologic correlation recommended.", ["definitely", "certainly", "proven", "confirmed", "100%", "always", "never", "diagnostic of", "consistent with"], {}),
}
#: The report's template.
TEMPLATE = (
    "MRI BRAIN WITH CONTRAST\n\nPATIENT ID: {patient_id}\nDATE: {exam_date}\n\nCLINICAL INDICATION:\n{clinical_indication}\n\nTECHNIQUE:\n"
    "Multiplanar, multisequence MRI of the brain was performed including {sequences_list}. {contrast_sentence}\n\nCOMPARISON:\n{comparison}\n\nFINDINGS:\n"
    "{lesion_count_sentence} {dominant_lesion_sentence}\n\n{enhancement_sentence} {necrosis_sentence} {edema_sentence}\n\n{mass_effect_sentence}\n\n"
    "{ventricles_sentence} {parenchyma_sentence}\n\nIMPRESSION:\n1. {impression_summary}\n2. {impression_differential}\n\nDISCLAIMER:\n"
    "This report was generated with automated assistance and should be reviewed by a qualified radiologist."
)
MARKERS = ("FINDINGS", "IMPRESSION", "TECHNIQUE", "COMPARISON")
FRAGMENTS = {"^[a-z]": "^[a-z]", r",\s*$": r",\s*$", r"^\s*and\s": r"^\s*and\s", r"^\s*with\s": r"^\s*with\s", r",\s*,": r",\s*,", r"\s{2,}": r"\s{2,}"}


def slot_specs(spark: SparkSession) -> DataFrame:
    """The slot table: 16 rows, of which two have no rules of their own."""
    rows = []
    for k, (name, s) in enumerate(SLOTS.items()):
        section, most, fallback, forbidden, allowed = s or (None, None, None, [], {})
        rows.append((name, k, section, most, fallback, forbidden, SECTION_TERMS.get(section, []), allowed))
    return spark.createDataFrame(rows, "slot string, place int, section string, max_length int, fallback string, forbidden array<string>, section_terms array<string>, allowed map<string,array<string>>")


def _among_any(low: Column, *terms: str) -> Column:
    """Whether a text holds one of the terms.

    Asked by a lambda: columns beside it are compiled in small pieces then.  All facts
    in one piece are too long for the JVM's compiler, and a case took several times as long.
    """
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def facts(summary: DataFrame) -> DataFrame:
    """The facts of each case, flat, with defaults for what a summary lacks."""
    c = F.col
    lower = lambda n: F.lower(F.coalesce(c(n), F.lit("")))
    count = F.coalesce(c("multiplicity.lesion_count"), F.lit(1))
    lobes, hemi = F.coalesce(c("location.involved_lobes"), F.array().cast("array<string>")), F.coalesce(c("location.hemisphere"), F.lit("unknown"))
    named = F.when(F.size(lobes) == 0, F.concat(hemi, F.lit(" "), F.coalesce(c("location.primary_lobe"), F.lit("unknown")), F.lit(" lobe"))).otherwise(
        F.concat(hemi, F.lit(" "), oxford(lobes), F.when(F.size(lobes) == 1, " lobe").otherwise(" lobes")))
    depth = lower("location.depth")
    edema, total = F.coalesce(c("tumor_characteristics.edema_volume_cm3"), F.lit(0.0)), F.coalesce(c("tumor_characteristics.volume_cm3"), F.lit(0.0))
    share = F.coalesce(c("necrosis.percentage"), F.lit(0.0)) / 100
    pattern = lower("multiplicity.distribution_pattern")
    default = F.array(*[F.lit(x) for x in ("high-grade glioma", "metastasis", "lymphoma")])
    return summary.select(
        "case_id", count.alias("lesion_count"), (count > 1).alias("is_multifocal"),
        F.when(count == 1, "focal").when(_among_any(pattern, "distant", "multicentric"), "multifocal or multicentric").otherwise("multifocal").alias("distribution"),
        hemi.alias("hemisphere"), F.coalesce(c("location.primary_lobe"), F.lit("unknown")).alias("primary_lobe"), named.alias("lobes_formatted"),
        F.when(F.contains(depth, F.lit("subcortical")), "subcortical ").when(F.contains(depth, F.lit("deep")), "deep ").when(F.contains(depth, F.lit("cortical")), "cortical and subcortical ")
        .when(F.contains(depth, F.lit("periventricular")), "periventricular ").otherwise("").alias("depth_prefix"),
        half_centimetres(F.coalesce(c("tumor_characteristics.max_diameter_mm"), F.lit(0.0))).alias("size_cm"),
        F.coalesce(c("enhancement.present"), F.lit(False)).alias("enhancement_present"), lower("enhancement.heterogeneity").alias("heterogeneity"),
        F.contains(lower("enhancement.pattern"), F.lit("ring")).alias("is_ring"), F.coalesce(c("necrosis.present"), F.lit(False)).alias("necrosis_present"),
        F.when(~F.coalesce(c("necrosis.present"), F.lit(False)), "none").when(share < 0.01, "none").when(share < 0.1, "minimal").when(share < 0.3, "moderate").when(share < 1, "extensive").otherwise("minimal").alias("necrosis_degree"),
        F.when(total > 0, F.least(edema / total, F.lit(1.0))).otherwise(0.0).alias("edema_ratio"),
        F.when(edema < 5, "Minimal").when(edema < 15, "Moderate").when(edema < 30, "Significant").otherwise("Extensive").alias("edema_degree"),
        F.coalesce(c("mass_effect.midline_shift_mm"), F.lit(0.0)).alias("shift_mm"), F.coalesce(c("mass_effect.midline_shift_mm") >= 2.0, F.lit(False)).alias("shift_significant"),
        F.coalesce(c("mass_effect.shift_direction"), F.lit("")).alias("shift_direction"), F.lower(F.coalesce(c("morphology.shape"), F.lit("mass"))).alias("shape"),
        F.contains(F.lower(F.coalesce(c("normal_structures.ventricular_system.size"), F.lit("Normal"))), F.lit("normal")).alias("ventricles_normal"),
        (~F.contains(F.lower(F.coalesce(c("normal_structures.ventricular_system.symmetry"), F.lit("Symmetric"))), F.lit("asymmetric"))).alias("ventricles_symmetric"),
        F.coalesce(c("normal_structures.ventricular_system.hydrocephalus"), F.lit(False)).alias("hydrocephalus"),
        F.contains(F.lower(F.coalesce(c("normal_structures.parenchyma.overall"), F.lit("Normal"))), F.lit("normal")).alias("parenchyma_normal"),
        F.coalesce(c("normal_structures.parenchyma.white_matter_disease"), F.lit(False)).alias("white_matter_disease"),
        F.coalesce(c("technique.sequences_performed"), F.array().cast("array<string>")).alias("sequences"), F.coalesce(c("technique.contrast_administered"), F.lit(False)).alias("contrast_given"),
        F.coalesce(c("patient_info.relevant_prior_imaging") != NOT_GIVEN, F.lit(False)).alias("prior_imaging"),
        F.when(F.size(F.coalesce(c("differential_considerations"), F.array().cast("array<string>"))) > 0, c("differential_considerations")).otherwise(default).alias("differentials"),
    )


def slot_texts(f: DataFrame, date: Column) -> DataFrame:
    """``(case_id, texts)``: a case's slots in the report's order, with one sentence each (the wordings are fixed values)."""
    c, s = F.col, F.format_string
    seq = F.transform("sequences", lambda q: F.when(F.upper(q) == "T1", "T1-weighted").when(F.upper(q) == "T1CE", "post-contrast T1-weighted").when(F.upper(q) == "T2", "T2-weighted").when(F.upper(q) == "FLAIR", "FLAIR").otherwise(q))
    shape = F.when((c("shape") != "") & (c("shape") != "mass"), F.concat("shape", F.lit(" "))).otherwise("")
    first = F.when(c("depth_prefix") != "", c("depth_prefix")).otherwise(shape)
    mixed = F.contains(c("heterogeneity"), F.lit("heterogeneous"))
    size = c("size_cm").cast("string")
    kind = lambda d: F.when(F.contains(d, F.lit("glioma")) | F.contains(d, F.lit("glioblastoma")), "high-grade glioma").when(F.contains(d, F.lit("metast")), "metastatic disease").when(F.contains(d, F.lit("lymphoma")), "primary CNS lymphoma").otherwise(d)
    diff = F.array_distinct(F.transform(F.slice("differentials", 1, 3), lambda d: kind(F.lower(d))))
    f = f.repartition("case_id")  # sixteen texts come from a small row: a file of few splits would leave them to few tasks
    f = f.withColumns({"__seq": seq, "__diff": diff})  # lists that a text names item by item, made once
    seq, diff = c("__seq"), c("__diff")
    shift = F.round("shift_mm", 1).cast("string")
    values = {
        "patient_id": c("case_id").cast("string"), "exam_date": date, "clinical_indication": F.lit("Clinical indication not provided."),
        "sequences_list": F.when(F.size("sequences") == 0, "standard sequences").otherwise(oxford(seq)),
        "contrast_sentence": F.when(c("contrast_given"), SLOTS["contrast_sentence"][2]).otherwise("No intravenous contrast was administered."),
        "comparison": F.when(c("prior_imaging"), "Compared to prior examination.").otherwise("No prior imaging available for comparison."),
        "lesion_count_sentence": F.when(c("lesion_count") == 1, s("A single enhancing lesion is identified within the %s cerebral hemisphere.", "hemisphere"))
        .when(c("lesion_count") == 2, s("Two spatially separate enhancing lesions are identified within the %s cerebral hemisphere.", "hemisphere"))
        .otherwise(s("Multiple enhancing lesions (%d) are identified with a %s distribution.", "lesion_count", "distribution")),
        "dominant_lesion_sentence": s("The dominant lesion is %s %s%smass located in the %s, measuring approximately %s cm in maximum diameter.", article(first), "depth_prefix", shape, "lobes_formatted", size),
        "enhancement_sentence": F.when(~c("enhancement_present"), "No abnormal enhancement is identified.").when(c("is_ring") & mixed, "The lesion demonstrates heterogeneous ring enhancement.")
        .when(c("is_ring"), "The lesion demonstrates ring enhancement with a non-enhancing central component.").when(mixed, "The lesion demonstrates heterogeneous enhancement following contrast administration.")
        .otherwise("The lesion demonstrates homogeneous enhancement following contrast administration."),
        "necrosis_sentence": F.when(~c("necrosis_present"), "No central necrosis is identified.").when(c("necrosis_degree") == "minimal", "A small central necrotic component is identified.")
        .when(c("necrosis_degree") == "extensive", "A large area of central necrosis is present.").otherwise("Central necrosis is present within the lesion."),
        "edema_sentence": F.concat("edema_degree", F.lit(" surrounding T2/FLAIR hyperintensity is present"), F.when(c("edema_degree").isin("Extensive", "Significant"), ", representing vasogenic edema.").otherwise(".")),
        "mass_effect_sentence": F.when(~c("shift_significant"), "No significant midline shift is identified. No evidence of herniation.")
        .when(c("shift_direction") != "", s("There is approximately %s mm of midline shift to the %s. No evidence of herniation.", shift, "shift_direction")).otherwise(s("There is approximately %s mm of midline shift. No evidence of herniation.", shift)),
        "ventricles_sentence": F.when(c("hydrocephalus"), "The ventricular system demonstrates ventriculomegaly.")
        .when(~c("ventricles_symmetric"), "The ventricular system is normal in size with mild asymmetry of the lateral ventricles.").otherwise("The ventricular system is normal in size and configuration."),
        "parenchyma_sentence": F.when(c("white_matter_disease"), "Background white matter changes are noted. Gray-white matter differentiation is otherwise preserved.")
        .when(c("parenchyma_normal"), "The remaining brain parenchyma demonstrates preserved gray-white matter differentiation.").otherwise("The remaining brain parenchyma appears unremarkable."),
        "impression_summary": F.when(c("is_multifocal") & c("is_ring"), s("Multifocal ring-enhancing masses in the %s cerebral hemisphere, largest measuring approximately %s cm, suspicious for high-grade neoplastic process.", "hemisphere", size))
        .when(c("is_multifocal"), s("Multifocal enhancing masses in the %s cerebral hemisphere, imaging features suspicious for neoplastic process.", "hemisphere"))
        .when(c("is_ring"), s("Ring-enhancing mass in the %s %s lobe, measuring approximately %s cm, suspicious for high-grade neoplastic process.", "hemisphere", "primary_lobe", size))
        .otherwise(s("Enhancing mass in the %s %s lobe, measuring approximately %s cm, with imaging features concerning for neoplastic process.", "hemisphere", "primary_lobe", size)),
        "impression_differential": F.concat(F.lit("Differential diagnosis includes "), F.when(F.size(diff) == 0, "high-grade neoplasm").otherwise(oxford(diff, True)), F.lit(". Clinical and histopathologic correlation recommended.")),
    }
    return f.select("case_id", F.array(*[F.struct(F.lit(n).alias("slot"), v.alias("content")) for n, v in values.items()]).alias("texts"))


def slot_values(f: DataFrame, date: Column) -> DataFrame:
    """``(case_id, slot, content)``: the slots of every case, a row each."""
    return _apart(slot_texts(f, date)).select("case_id", "v.slot", "v.content")


def _apart(cases: DataFrame) -> DataFrame:
    """A row for each text of a case, as ``v``.

    A plain ``explode`` would first ask each case whether its list is empty, by a
    filter that makes all its texts once more where the cases are read.  No list is.
    """
    return cases.select(*[c for c in cases.columns if c != "texts"], F.explode_outer("texts").alias("v"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used (lambdas would repeat it for every term)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _masked(low: Column) -> Column:
    """Lower-case text with the first occurrence of each allowed compound blanked in place."""
    out = low
    for w in COMPOUNDS:
        at = F.locate(w, low)
        out = F.when(at > 0, F.overlay(out, F.lit("\x01" * len(w)), at)).otherwise(out)
    return F.when(F.contains(low, F.lit("histopathology")) | F.contains(low, F.lit("histopathologic")), out).otherwise(low)


def _among(terms: Column, low: Column) -> Column:
    """The terms that a lower-case text holds."""
    return F.filter(terms, lambda t: F.contains(low, F.lower(t)))


#: Bits of what a text tells: first the concepts of OWNERS that it names, then whether it holds a banned word, then by place the slots whose terms it holds.
_BANNED = len(OWNERS)
_PLACES = _BANNED + 1


def _least(terms: dict[str, int]) -> list[tuple[str, int]]:
    """The terms but those that hold another one which says as much."""
    return [(t, bits) for t, bits in terms.items() if not any(o != t and o in t and b & bits == bits for o, b in terms.items())]


def _teller(specs: DataFrame) -> Callable[[str], int]:
    """A function from a text to its bits; ``specs`` has a row for each slot."""
    terms: dict[str, int] = {}
    for k, concept in enumerate(OWNERS):
        for t in (concept, concept.replace("_", " ")):
            terms[t] = terms.get(t, 0) | 1 << k
    for r in specs.select("place", "section_terms", "forbidden").collect():
        for t in (*(r.section_terms or []), *(r.forbidden or [])):
            terms[t.lower()] = terms.get(t.lower(), 0) | 1 << _PLACES + r.place
    terms = _least(terms)
    banned = [b for b, _ in _least({b.lower(): 0 for b in BANNED})]

    def bits(text: str) -> int:
        low, out = text.lower(), 0
        for t, told in terms:
            if t in low:
                out |= told
        if any(b in low for b in banned):
            safe = low
            for w in COMPOUNDS:
                at = low.find(w)
                if at >= 0:
                    safe = safe[:at] + "\x01" * len(w) + safe[at + len(w) :]
            if any(b in safe for b in banned):
                out |= 1 << _BANNED
        return out

    return bits


def _told(specs: DataFrame, of_lists: bool = False) -> Callable[[Column], Column]:
    """The bits of a text, or of each text of a list; texts that a batch repeats are read once."""
    teller = _teller(specs)

    def each(texts: pa.Array) -> pa.Array:
        d = texts.dictionary_encode()
        return pa.array([teller(x) for x in d.dictionary.to_pylist()], pa.int64()).take(d.indices).fill_null(0)

    def of_each(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each(lists.flatten()))

    return F.arrow_udf(of_each, "array<bigint>") if of_lists else F.arrow_udf(each, "bigint")


def banned_words(text: Column) -> Column:
    """Banned words outside the allowed compounds, in the order of the list."""
    return _let(F.lower(text), lambda low: _let(_masked(low), lambda safe: _among(F.array(*[F.lit(b) for b in BANNED]), safe)))


def held(terms: Column, text: Column) -> Column:
    return _let(F.lower(text), lambda low: _among(terms, low))


def _verdict(text: Column) -> Column:
    """``(state, problems)`` of a text that breaks a rule of its slot, from its words."""
    none = F.array().cast("array<string>")
    replaced = F.coalesce("fallback", F.lit("")) != ""

    def told(x: Column) -> Column:
        ban, sec, own = x["ban"], x["sec"], x["own"]
        state = F.when(ban.isNotNull(), "[BANNED]").when(F.size(sec) > 0, "[SECTION_VIOLATION]").when(F.size(own) > 0, "[SLOT_VIOLATION]")
        problems = F.concat(
            F.when(ban.isNotNull(), F.array(F.concat(F.lit("Global banned: '"), ban, F.lit("'")))).otherwise(F.transform(sec, lambda t: F.concat(F.lit("Section '"), F.col("section"), F.lit("' forbidden term: '"), t, F.lit("'")))),
            F.when(state == "[SLOT_VIOLATION]", F.transform(own, lambda t: F.concat(F.lit("Slot forbidden: '"), t, F.lit("'")))).otherwise(none),
            F.when(state.isNotNull() & replaced, F.array(F.lit("Used fallback due to validation failure"))).otherwise(none),
        )
        return F.struct(state.alias("state"), problems.alias("problems"))

    def words(low: Column, safe: Column) -> Column:
        ban = F.coalesce(*[F.when(F.contains(safe, F.lit(b.lower())), F.lit(b)) for b in BANNED])
        sec, own = _among(F.coalesce("section_terms", none), low), F.slice(_among(F.coalesce("forbidden", none), low), 1, 1)
        return F.struct(ban.alias("ban"), sec.alias("sec"), own.alias("own"))

    return _let(F.lower(text), lambda low: _let(_masked(low), lambda safe: _let(words(low, safe), told)))


def _judged(values: DataFrame, specs: DataFrame) -> DataFrame:
    """``values`` with their bits as ``__told``, the outcome of all checks but concepts told twice, and two sets of bits.

    ``__said`` has a bit for each concept of OWNERS that a text without violations
    names, ``__mine`` those of them that its slot owns.  Only a text whose bits say
    that it breaks a rule is asked for each term.  Others do without the lists of
    terms, which are longer than most texts.
    """
    none = F.array().cast("array<string>")
    c, text, told = F.col, F.col("content"), F.col("__told")
    mine = reduce(Column.bitwiseOR, [F.when(c("slot") == owner, 1 << k).otherwise(0) for k, owner in enumerate(OWNERS.values())])
    v = values.join(F.broadcast(specs.withColumn("__mine", mine)), "slot", "left")
    held = (F.getbit(told, F.lit(_BANNED)) == 1) | F.coalesce(F.getbit(told, c("place") + _PLACES) == 1, F.lit(False))
    v = v.withColumn("__held", held).withColumns({n: F.when(c("__held"), c(n)) for n in ("section", "fallback", "section_terms", "forbidden")})
    v = v.withColumn("__verdict", F.when(c("__held"), _verdict(text))).drop("section", "section_terms", "forbidden")
    state = c("__verdict.state")
    # characters are counted only where the bytes leave it open
    long = state.isNull() & (F.octet_length(text) > c("max_length")) & (F.length(text) > c("max_length"))
    kept = F.when(state.isNotNull() & (F.coalesce("fallback", F.lit("")) != ""), c("fallback")).when(state.isNotNull(), state)
    exceeds = F.array(F.concat(F.lit("Exceeds max length ("), F.length(text), F.lit(" > "), c("max_length"), F.lit(")")))
    return v.select(
        *[n for n in values.columns if n != "__told"], "place", kept.when(long, F.concat(F.substring(text, F.lit(1), c("max_length") - 3), F.lit("..."))).otherwise(text).alias("__kept"),
        F.when(state.isNotNull(), c("__verdict.problems")).when(long, exceeds).otherwise(none).alias("__problems"),
        F.when(state.isNull(), told.bitwiseAND(F.lit((1 << len(OWNERS)) - 1))).otherwise(0).alias("__said"), F.coalesce("__mine", F.lit(0)).alias("__mine"),
    )


def _with_repeats(owned: Column, owner_place: Callable[[str], Column]) -> Column:
    """The violations of a judged text with the concepts that an earlier slot has said; ``owned`` are the case's bits."""
    told, both = [], F.col("__said").bitwiseAND(owned)
    for k, (concept, owner) in enumerate(OWNERS.items()):
        here = (both.bitwiseAND(F.lit(1 << k)) != 0) & (F.col("slot") != owner) & (owner_place(owner) < F.col("place"))
        told.append(F.when(here, F.lit(f"Concept '{concept}' already reported by '{owner}'")))
    # a text that names a concept has no fallback, so concepts come last
    return F.when(both != 0, F.concat("__problems", F.filter(F.array(*told), lambda x: x.isNotNull()))).otherwise(F.col("__problems"))


def validate(values: DataFrame, specs: DataFrame) -> DataFrame:
    """``(case_id, slot, place, original, sanitized, violations)``.

    Checks in order: banned words, section terms, slot terms (first hit), length,
    concepts that an earlier slot owns.  A failed text is replaced by the slot's
    fallback where it has one.  A text is judged where it lies; what is shuffled
    by case is the text, the outcome and two sets of bits.
    """
    owners = list(dict.fromkeys(OWNERS.values()))
    places = specs.agg(*[F.min(F.when(F.col("slot") == o, F.col("place"))).alias(f"__at{k}") for k, o in enumerate(owners)])
    v = _judged(values.select("case_id", "slot", "content", _told(specs)(F.col("content")).alias("__told")), specs)
    v = v.withColumn("__owned", F.bit_or(F.col("__said").bitwiseAND(F.col("__mine"))).over(Window.partitionBy("case_id"))).crossJoin(F.broadcast(places))
    violations = _with_repeats(F.col("__owned"), lambda o: F.col(f"__at{owners.index(o)}"))
    return v.select("case_id", "slot", "place", F.col("content").alias("original"), F.col("__kept").alias("sanitized"), violations.alias("violations"))


def validate_whole(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """``validate`` for cases that hold all their slots in one row, as ``slot_texts`` gives them: nothing is shuffled."""
    place = {n: k for k, n in enumerate(SLOTS)}
    v = texts.select("case_id", "texts", _told(specs, of_lists=True)(F.col("texts.content")).alias("__told"))
    owned = F.lit(0)
    for o in dict.fromkeys(OWNERS.values()):
        told, mine = F.get("__told", F.lit(place[o])), sum(1 << k for k, owner in enumerate(OWNERS.values()) if owner == o)
        broken = told.bitwiseAND(F.lit(1 << _BANNED | 1 << _PLACES + place[o])) != 0
        owned = owned.bitwiseOR(F.when(broken, 0).otherwise(told.bitwiseAND(F.lit(mine))))
    v = _apart(v.select("case_id", F.coalesce(owned, F.lit(0)).alias("__owned"), F.arrays_zip("texts", "__told").alias("texts")))
    v = v.select("case_id", "__owned", "v.texts.slot", "v.texts.content", "v.__told")
    violations = _with_repeats(F.col("__owned"), lambda o: F.lit(place[o]))
    return _judged(v, specs).select("case_id", "slot", "place", F.col("content").alias("original"), F.col("__kept").alias("sanitized"), violations.alias("violations"))


def integrity(text: Column) -> Column:
    """Signs of a sentence fragment; offered by itself."""
    t = F.trim(text)
    end = (F.length(text) > 0) & ~F.rlike(t, F.lit(r"[.?!]$")) & ~F.rlike(t, F.lit(r"^(1\.|2\.|-|\*)"))
    return F.concat(F.filter(F.array(*[F.lit(p) for p in FRAGMENTS]), lambda p: F.rlike(text, p)), F.filter(F.array(F.when(end, F.lit("no terminal punctuation"))), lambda x: x.isNotNull()))


def allowed_value(specs: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` (slot, field, value) with ``valid``: in the slot's list, or the list is empty."""
    j = values.join(F.broadcast(specs.select("slot", "allowed")), "slot", "left")
    options = F.coalesce(F.col("allowed")[F.col("field")], F.array().cast("array<string>"))
    return j.withColumn("valid", (F.size(options) == 0) | F.exists(options, lambda o: F.lower(o) == F.lower(F.col("value")))).drop("allowed")


def fill(checked: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``(case_id, report)``: the template with every slot's text."""
    wide = checked.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "sanitized"))).alias("m"))
    return _filled(wide, lambda name: F.col("m")[name], template)


def fill_whole(texts: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``fill`` for cases that hold all their slots in one row, as ``slot_texts`` gives them: nothing is shuffled."""
    place = {n: k for k, n in enumerate(SLOTS)}
    return _filled(texts, lambda name: F.get("texts", F.lit(place[name]))["content"], template)


def _filled(wide: DataFrame, of: Callable[[str], Column], template: str) -> DataFrame:
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), F.coalesce(of(name), F.lit(""))]
    return wide.select("case_id", F.regexp_replace(F.concat(*parts, F.lit(rest)), "\n{3,}", "\n\n").alias("report"))


def sections(text: Column) -> Column:
    """Section name to its text, each from its marker to the next marker after it."""
    body = lambda m: F.trim(F.regexp_extract(text, rf"(?s)^.*?{m}:(.*?)(?=(?:{'|'.join(o for o in MARKERS if o != m)}):|\z)", 1), F.lit(" \n\t"))
    entries = F.array(*[F.struct(F.lit(m).alias("name"), F.when(F.contains(text, F.lit(f"{m}:")), body(m)).alias("text")) for m in MARKERS])
    return F.map_from_entries(F.filter(entries, lambda e: e["text"].isNotNull()))


def _without(text: Column, term: Column) -> Column:
    """A term's whole-word occurrences removed, whatever their case."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)\b\Q"), term, F.lit(r"\E\b")), F.lit(""))


def final_pass(reports: DataFrame) -> DataFrame:
    """``(case_id, report, notes)``: section terms, repeated concepts, fragments, spaces and banned words."""
    r = reports.withColumn("s", sections(F.col("report")))
    parts = []
    for name, terms in SECTION_TERMS.items():
        found = held(F.array(*[F.lit(t) for t in terms]), F.coalesce(F.col("s")[name], F.lit("")))
        parts.append(_sectioned(found, name))
    r = r.withColumn("hits", F.concat(*parts))
    r = r.withColumn("report", F.aggregate("hits", F.col("report"), lambda acc, h: _without(acc, h["term"])))
    counts = _let(F.lower("report"), lambda low: F.array(*[F.struct(F.lit(k).alias("c"), F.when(F.contains(low, F.lit(k.replace("_", " "))), F.regexp_count(low, F.lit(k.replace("_", " ")))).otherwise(0).alias("n")) for k in OWNERS]))
    r = r.withColumn("repeats", F.filter(counts, lambda x: x["n"] > 1))
    grammar = {r",\s*\.": "Comma before period", r",\s*,": "Double comma", r"\.\s*\.": "Double period", r"\s{3,}": "Excessive whitespace"}
    noted = []
    for k, (p, name) in enumerate(grammar.items()):
        r = r.withColumn(f"g{k}", F.when(F.rlike("report", F.lit(p)), F.lit(f"Grammar issue: {name}"))).withColumn("report", F.regexp_replace("report", p, " "))
        noted.append(F.col(f"g{k}"))
    for p, w in ((r"\n\s*\.\s*\n", "\n"), (r"\s+,\s+", " "), (r" {2,}", " "), ("\n{3,}", "\n\n")):
        r = r.withColumn("report", F.regexp_replace("report", p, w))
    r = r.withColumn("banned", banned_words(F.col("report")))
    r = r.withColumn("report", F.aggregate("banned", F.col("report"), lambda acc, b: _without(acc, b)))
    notes = F.concat(
        F.transform("hits", lambda h: F.concat(F.lit("Section '"), h["section"], F.lit("' contains forbidden term: '"), h["term"], F.lit("'"))),
        F.transform("repeats", lambda x: F.concat(F.lit("Concept '"), x["c"], F.lit("' appears "), x["n"], F.lit(" times"))),
        F.filter(F.array(*noted), lambda x: x.isNotNull()), F.transform("banned", lambda b: F.concat(F.lit("Final check caught banned term: '"), b, F.lit("'"))),
    )
    return r.select("case_id", "report", notes.alias("notes"))


def concept_mentions(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with each concept (as worded) and how often a text names it."""
    names = F.array(*[F.lit(k.replace("_", " ")) for k in OWNERS])
    return texts.withColumn("concept", F.explode(names)).withColumn("mentions", F.coalesce(F.regexp_count(F.lower(column), F.col("concept")), F.lit(0)))


def _sectioned(terms: Column, name: str) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(name).alias("section"), t.alias("term")))


def impression_items(text: Column) -> Column:
    """Numbered items of the impression; continuation lines belong to their item."""
    body = F.regexp_extract(text, r"(?s)IMPRESSION:(.*?)(?:DISCLAIMER:|\z)", 1)
    items = F.split(F.regexp_replace(F.trim(body, F.lit(" \n")), r"(?m)^\s*\d+\.\s*", "\x01"), "\x01")
    return F.transform(F.filter(items, lambda i: F.length(F.trim(i, F.lit(" \n"))) > 0), lambda i: F.regexp_replace(F.trim(i, F.lit(" \n")), r"\s*\n\s*", " "))


def validation_log(checked: DataFrame) -> DataFrame:
    """The texts that broke a rule, as written and as corrected.

    The violations of a text are put into a list of one that is taken apart, so that
    the condition is asked of them; moved to the texts it would judge them many times.
    """
    told = checked.select("case_id", "slot", "original", "sanitized", F.explode(F.array("violations")).alias("violations"))
    return told.where(F.size("violations") > 0).withColumn("violations", F.array_join("violations", "; "))


def report_bundle(summary: DataFrame, run_date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(reports, validation log, facts)`` of one plan."""
    f = facts(summary)
    date = F.date_format(F.lit(run_date).cast("date"), "MMMM dd, yyyy")
    checked = validate_whole(slot_texts(f, date), slot_specs(summary.sparkSession))
    reports = final_pass(fill(checked))
    return reports, validation_log(checked), f
