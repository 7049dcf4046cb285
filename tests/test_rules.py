"""Closed-form answers of label, evaluation, report and status rules."""
import pytest
from pyspark.sql import functions as F

from cohortvox.functions import text as X
from cohortvox.operators import evaluate as E, intensity as I, masks as M, mass_effect as ME, morphology as S, retrieval as R
from cohortvox.plans import report as P
from cohortvox.sources.voxels import dense
from cohortvox.sources.workspace import Workspace, shared_folder
from cohortvox.streaming import stages as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_ensembles(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 3), (0, 3), (3, 3)], "a int, b int").coalesce(1)
    assert [r[0] for r in pairs.select(M.ensemble_mean(F.col("a"), F.col("b"))).collect()] == [0, 2, 2, 2, 2, 3]
    votes = spark.createDataFrame([(1, v) for v in (3, 1, 3, 1, 2)], "k int, label int")
    assert M.ensemble_mode(votes, ["k"]).first().label == 1


def test_dice(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 3, 3), (1, 0, 3)], "case_id int, p int, g int")
    got = {r.label: round(r.dice, 6) for r in E.label_scores(df, "p", "g").collect()}
    assert got == {1: 0.666667, 2: 0.666667, 3: 0.666667}
    comp = {r.compound: round(r.dice, 6) for r in E.compound_scores(df, "p", "g").collect()}
    assert comp == {"WT": 0.888889, "TC": 0.666667, "ET": 0.666667}
    assert round(E.mean_dice(df, "p", "g").first().mean_dice, 6) == 0.740741


@pytest.mark.parametrize("ratio, want", [(0.59, "markedly hypointense"), (0.6, "hypointense"), (0.85, "isointense"), (1.15, "hyperintense"), (1.5, "markedly hyperintense")])
def test_signal_edges(spark, ratio, want):
    assert one(spark, v=I.signal_label(F.lit(ratio))).v == want


def test_cube_shape(spark):
    rows = [(1, x, y, z, 1.0, 1.0, 1) for x in range(5, 10) for y in range(5, 10) for z in range(5, 10)]
    vox = spark.createDataFrame(rows, "case_id long, x long, y long, z long, t1 double, t1ce double, seg int")
    geo = spark.createDataFrame([(1, 15, 15, 15, 1.0, 1.0, 1.0), (2, 3, 3, 3, 1.0, 1.0, 1.0)], "case_id long, nx int, ny int, nz int, dx double, dy double, dz double")
    got = {r.case_id: r for r in S.shape(dense(vox, geo)).collect()}
    r = got[1]
    assert (r.volume_cm3, r.surface_mm2, r.sphericity, r.compactness, round(r.elongation, 6)) == (0.125, 98.0, 1.0, 1.0, 1.0)
    assert got[2].volume_cm3 == 0 and got[2].shape_class is None
    d = dense(vox, geo)
    assert {r.case_id: r.classification for r in S.margin(d).collect()}[2] == "No tumor"
    loc = {r.case_id: r for r in ME.location(d).collect()}
    assert loc[2].hemisphere == "None" and loc[2].depth == "No tumor detected"


def test_eigenvalues(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(5):
        b = rng.normal(size=(3, 3))
        a = b @ b.T
        names = {"xx": a[0, 0], "yy": a[1, 1], "zz": a[2, 2], "xy": a[0, 1], "xz": a[0, 2], "yz": a[1, 2]}
        e = S.eigenvalues({k: F.lit(float(v)) for k, v in names.items()})
        got = one(spark, a=e[0], b=e[1], c=e[2])
        assert np.allclose(sorted(got, reverse=True), sorted(np.linalg.eigvalsh(a), reverse=True))
    e = S.eigenvalues({k: F.lit(1.0 if k[0] == k[1] else 0.0) for k in ("xx", "yy", "zz", "xy", "xz", "yz")})
    assert list(one(spark, a=e[0], b=e[1], c=e[2])) == [1.0, 1.0, 1.0]


def test_text_helpers(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, a=X.oxford(a("p")), b=X.oxford(a("p", "q")), c=X.oxford(a("p", "q", "r")), d=X.oxford(a("p", "q"), True), e=X.half_centimetres(F.lit(37.0)), f=X.article(F.lit("ovoid ")))
    assert tuple(r) == ("p", "p and q", "p, q, and r", "p, and q", 3.5, "an")


def test_validator(spark):
    rows = [
        (1, "edema_sentence", "Edema volume is large."), (1, "enhancement_sentence", "Definitive malignant pattern."), (1, "impression_summary", "Ring mass, suspicious for a process."),
        (1, "impression_differential", "Clinical and histopathologic correlation recommended."), (1, "parenchyma_sentence", "x" * 230), (1, "patient_id", "malignant"),
        (2, "necrosis_sentence", "Central necrosis is present."), (2, "ventricles_sentence", "There is necrosis nearby."), (2, "dominant_lesion_sentence", "Suspicious tumor."),
    ]
    got = {(r.case_id, r.slot): r for r in P.validate(spark.createDataFrame(rows, "case_id int, slot string, content string"), P.slot_specs(spark)).collect()}
    assert got[1, "edema_sentence"].violations == ["Slot forbidden: 'volume'", "Used fallback due to validation failure"]
    assert got[1, "enhancement_sentence"].violations[0] == "Global banned: 'definitive'" and got[1, "enhancement_sentence"].sanitized.startswith("Enhancement is noted")
    assert got[1, "impression_summary"].violations == [] and got[1, "impression_differential"].violations == []
    assert len(got[1, "parenchyma_sentence"].sanitized) == 200 and got[1, "parenchyma_sentence"].sanitized.endswith("...")
    assert got[1, "patient_id"].sanitized == "[BANNED]"
    assert got[2, "necrosis_sentence"].violations == [] and got[2, "ventricles_sentence"].violations == ["Concept 'necrosis' already reported by 'necrosis_sentence'"]
    assert got[2, "dominant_lesion_sentence"].violations[:2] == ["Section 'FINDINGS' forbidden term: 'suspicious'", "Section 'FINDINGS' forbidden term: 'tumor'"]


def test_final_pass(spark):
    text = "FINDINGS:\nA tumor , likely seen.\n\n\n\nNecrosis. More necrosis.\nIMPRESSION:\n1. Certainly one\nmore\n2. A confirmed histopathologic two.\n\nDISCLAIMER:\nx"
    r = P.final_pass(spark.createDataFrame([(1, text)], "case_id int, report string")).first()
    low = r.report.lower()
    assert not any(w in low for w in ("tumor", "likely", "certainly", "confirmed")) and "histopathologic" in low
    assert any("'necrosis' appears 2 times" in n for n in r.notes)
    items = spark.createDataFrame([(text,)], "t string").select(P.impression_items(F.col("t")).alias("i"), P.sections(F.col("t")).alias("s")).first()
    assert items.i == ["Certainly one more", "A confirmed histopathologic two."] and items.s["FINDINGS"].startswith("A tumor")


def test_facts_quirks(spark):
    s = spark.range(1).select(
        F.col("id").alias("case_id"), F.struct(F.lit("Abnormal findings present").alias("overall"), F.lit(False).alias("white_matter_disease")).alias("p"))
    full = s.select(
        "case_id", F.struct(F.lit(None).cast("string").alias("relevant_prior_imaging")).alias("patient_info"), F.struct(F.lit(None).cast("array<string>").alias("sequences_performed"), F.lit(None).cast("boolean").alias("contrast_administered")).alias("technique"),
        F.struct(F.lit(37.0).alias("max_diameter_mm"), F.lit(10.0).alias("volume_cm3"), F.lit(20.0).alias("edema_volume_cm3")).alias("tumor_characteristics"),
        F.struct(F.lit("left").alias("hemisphere"), F.lit("frontal").alias("primary_lobe"), F.array(F.lit("frontal"), F.lit("parietal")).alias("involved_lobes"), F.lit("Deep").alias("depth")).alias("location"),
        F.struct(F.lit(True).alias("present"), F.lit("Ring-enhancing").alias("pattern"), F.lit("Heterogeneous").alias("heterogeneity")).alias("enhancement"),
        F.struct(F.lit(2.0).alias("midline_shift_mm"), F.lit("Left to right").alias("shift_direction")).alias("mass_effect"), F.struct(F.lit("Ovoid").alias("shape")).alias("morphology"),
        F.struct(F.lit(True).alias("present"), F.lit(100.0).alias("percentage")).alias("necrosis"), F.struct(F.lit(2).alias("lesion_count"), F.lit("Distant multifocal").alias("distribution_pattern")).alias("multiplicity"),
        F.struct(F.struct(F.lit("Normal").alias("size"), F.lit("Symmetric").alias("symmetry"), F.lit(False).alias("hydrocephalus")).alias("ventricular_system"), F.col("p").alias("parenchyma")).alias("normal_structures"),
        F.array(F.lit("Glioblastoma"), F.lit("Metastases"), F.lit("Gliomatosis")).alias("differential_considerations"),
    )
    f = P.facts(full)
    r = f.first()
    assert r.parenchyma_normal and r.size_cm == 3.5 and r.edema_ratio == 1.0 and r.necrosis_degree == "minimal" and r.shift_significant
    v = {x.slot: x.content for x in P.slot_values(f, F.lit("d")).collect()}
    assert v["mass_effect_sentence"] == "There is approximately 2.0 mm of midline shift to the Left to right. No evidence of herniation."
    assert "a deep ovoid mass located in the left frontal and parietal lobes" in v["dominant_lesion_sentence"]
    assert v["impression_differential"].startswith("Differential diagnosis includes high-grade glioma, and metastatic disease.")


def test_term_top_k_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "banana"), (3, "")], "d long, text string")
    q = spark.createDataFrame([(7, "Apple!"), (8, "none known")], "q long, text string")
    got = R.term_top_k(R.term_index(docs, "d", "text"), docs, q, "d", "q", "text", 2).collect()
    assert sorted((r.query, r.rank, r.id, round(r.score, 4)) for r in got) == [(7, 1, 1, 0.7071), (7, 2, 2, 0.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0)]


def test_built_in_definitions_and_stores(spark):
    docs = R.definitions(spark)
    q = spark.createDataFrame([(1, "Midline shift!"), (2, "peritumoral edema")], "q long, text string")
    terms = R.term_top_k(R.term_index(docs, "id", "text"), docs, q, "id", "q", "text", 1)
    assert {r.query: r.id for r in terms.collect()} == {1: "Midline shift", 2: "Peritumoral edema"}


LINES = [(1, 1, "STAGE:segmenting"), (1, 3, "boom"), (1, 2, "STAGE:generating"), (2, 1, "STAGE:extracting"), (2, 2, "STAGE:error"), (2, 3, "last words"), (3, 1, "hello"), (4, 1, "STAGE:done STAGE:exporting")]
WANT = [(1, "running", "generating", 70, None), (2, "error", "error", 40, "last words"), (3, "running", "segmenting", 10, None), (4, "running", "exporting", 90, None)]


def test_status_in_batch_and_stream(spark, tmp_path):
    schema = "job_id int, pos int, line string"
    df = spark.createDataFrame(LINES, schema)
    assert sorted(map(tuple, T.fold_status(df).collect())) == WANT
    for k in range(4):
        spark.createDataFrame(LINES[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = T.fold_status(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("status").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("status").collect())) == WANT
    jobs = spark.createDataFrame([(1,), (9,)], "job_id int")
    assert {r.job_id: r.progress_pct for r in T.known_jobs(jobs, T.fold_status(df)).collect()} == {1: 70, 9: 0}


def test_workspace(spark):
    ws = Workspace(spark, "t")
    a, b = ws.table(spark.range(3)), ws.table(spark.range(4))
    kept = ws.keep(b.join(a, "id"), "k", 10)
    assert kept.count() == 3 and ws.root.startswith(shared_folder(spark))
    with pytest.raises(Exception):
        b.where("id = 3").count()


def test_whole_cases_are_judged_and_filled_without_a_shuffle(spark):
    from cohortvox.plans import report_queries as RQ

    texts = P.slot_texts(P.facts(RQ.case_summaries(spark, "/root/testdata/sf0.001")), F.lit("d")).limit(40).localCheckpoint()
    rows = texts.select("case_id", F.explode("texts").alias("v")).select("case_id", "v.slot", "v.content")
    whole, checked = P.validate_whole(texts, P.slot_specs(spark)), P.validate(rows, P.slot_specs(spark))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(whole) == plain(checked)
    assert plain(P.fill_whole(texts)) == plain(P.fill(rows.withColumnRenamed("content", "sanitized")))
    for df in (whole, P.fill_whole(texts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan


def test_a_condition_on_the_outcome_judges_no_text_again(spark):
    from cohortvox.plans import report_queries as RQ

    said = {"necrosis_sentence": "Necrosis is seen.", "edema_sentence": "A volume beside necrosis.", "ventricles_sentence": "There is necrosis.", "parenchyma_sentence": "A benign disease.", "impression_differential": "Histopathologic."}
    texts = spark.createDataFrame([(1, [(n, said.get(n, "Calm.")) for n in P.SLOTS]), (2, [(n, "Calm.") for n in P.SLOTS])], "case_id int, texts array<struct<slot:string,content:string>>")
    log = {r.slot: r for r in P.validation_log(P.validate_whole(texts, P.slot_specs(spark))).collect()}
    assert set(log) == {"edema_sentence", "ventricles_sentence", "parenchyma_sentence"} and {r.case_id for r in log.values()} == {1}
    assert log["ventricles_sentence"].violations == "Concept 'necrosis' already reported by 'necrosis_sentence'"
    plan = RQ.QUERIES["r26_validation_log"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all(len(line) < 200 for line in filters)


def test_bits_of_a_text_say_what_each_term_says(spark):
    told = P._teller(P.slot_specs(spark))
    terms = [*P.BANNED, *(t for s in P.SECTION_TERMS.values() for t in s), *(t for s in P.SLOTS.values() if s for t in s[3]), *P.COMPOUNDS, *P.OWNERS]
    texts = [t for a in terms for t in (a, f"x{a.upper()}y", f"Histopathological {a}", f"no {a.replace('_', ' ')}, {terms[len(a)]}.")] + ["", "Calm.", "histopathology histopathology", "HISTOPATHOLOGIC, pathologic"]
    for text in texts:
        low = safe = text.lower()
        for w in P.COMPOUNDS:
            if w in low:
                safe = safe[: low.index(w)] + "\x01" * len(w) + safe[low.index(w) + len(w) :]
        want = sum(1 << k for k, c in enumerate(P.OWNERS) if c in low or c.replace("_", " ") in low) | any(b.lower() in safe for b in P.BANNED) << P._BANNED
        for place, s in enumerate(P.SLOTS.values()):
            section, _, _, forbidden, _ = s or (None, None, None, [], {})
            want |= any(t.lower() in low for t in [*P.SECTION_TERMS.get(section, []), *forbidden]) << P._PLACES + place
        assert told(text) == want, text


def test_validated_sentences_are_compiled_in_pieces_that_the_jvm_takes(spark):
    import re

    from cohortvox.plans import report_queries as RQ

    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        plan = RQ.QUERIES["r14_r17_validated_sentences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        code = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set(key, before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # bytes of a method beyond which it is only interpreted
