"""From volume files to findings, summary, step texts and report."""
import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortvox.operators import evaluate as E, slices as L
from cohortvox.plans import step_texts as ST, summary as S
from cohortvox.sources import ingest as I, manifest as M
from cohortvox.sources.voxels import dense
from cohortvox.sources.workspace import Workspace
from test_sources import nifti


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Findings of one case with two lesions and one without tumour, read from volume files."""
    root = tmp_path_factory.mktemp("volumes")
    rng = np.random.default_rng(3)
    shape = (14, 12, 10)
    for case in ("c1", "c2"):
        base = rng.integers(60, 140, shape)
        seg = np.zeros(shape, int)
        if case == "c1":
            seg[2:8, 2:8, 2:8] = 2
            seg[3:7, 3:7, 3:7] = 3
            seg[4:6, 4:6, 4:6] = 1
            seg[11:13, 9:11, 7:9] = 3
        os.makedirs(f"{root}/in/{case}")
        for s, v in {"t1": base, "t1ce": base + 90 * (seg == 3), "t2": base + 40 * (seg > 0), "flair": base + 30 * (seg == 2), "seg": seg}.items():
            with open(f"{root}/in/{case}/{case}_{s}.nii.gz", "wb") as f:
                f.write(gzip.compress(nifti(v, "i2", 4, spacing=(2, 2, 3))))
    voxels, geometry = I.ingest(spark, f"file://{root}/in", f"{root}/out")
    grid = dense(voxels, geometry.drop("description"))
    m = M.manifest(M.scan(spark, f"file://{root}/in"))
    return S.findings(grid, Workspace(spark, "t"), ventricle_voxels=5, available=M.availability(m))


def test_step_texts(found):
    t = {r.case_id: r for r in ST.step_texts(found, model="test").collect()}
    a, b = t["c1"], t["c2"]
    assert "  Sequences performed: T1, T1ce, T2, FLAIR" in a.sequences and "  Slice thickness: 3.0 mm\n  In-plane resolution: 2.00 × 2.00 mm\n  Matrix size: 14 × 12 × 10" in a.sequences
    assert "  Necrotic Core (NCR):\n    T1 " in a.sequences and "  - Whole Tumor (WT): 2.69 cm³" in a.sequences
    assert "Lesion Count: 1" in a.multiplicity or "Lesion Count: 2" in a.multiplicity
    assert "  Primary lesion: 2.59 cm³, max diameter 15.0 mm\n    - Contains enhancing component" in a.multiplicity
    assert "Distribution Pattern: Solitary\n  Single contiguous lesion\n  Clinical implication: Unifocal disease" in a.multiplicity
    assert "    - Primary glioma" in a.multiplicity
    assert b.multiplicity.endswith("Lesion Count: 0\n  No tumor lesions detected")
    assert "Necrosis: Minimal necrosis" in a.morphology and "Small necrotic foci (4% of tumor)" in a.morphology
    assert a.quality.count("  • ") >= 3 and "Segmentation based on a test model" in a.quality and "Perfusion imaging" not in a.quality
    assert "    ⚠ No tumor segmentation detected" in b.quality
    assert "  - Mass effect score: " in a.mass_effect and "Brain Parenchyma:" in a.structures


def test_summary_and_report(found, spark, tmp_path):
    s = S.compile_summary(found, "2024-01-31")
    r = {x.case_id: x for x in s.collect()}["c1"]
    assert r.technique.sequences_not_available == ["DWI", "ADC", "MRS", "Perfusion"] and r.technique.acquisition_parameters.num_slices == 10
    assert list(r.technique.acquisition_parameters.voxel_size_mm) == [2.0, 2.0, 3.0] and r.patient_info.age == S.NOT_GIVEN
    assert set(r.signal_characteristics) == {"ncr", "ed", "et"} and r.signal_characteristics["et"].T1ce_ratio > 1.2
    assert set(r.quality_metrics.sequence_quality) == {"T1", "T1ce", "T2", "FLAIR"} and r.quality_metrics.confidence_high == ["enhancement_analysis", "multiplicity", "volume_measurements"]
    assert r.morphology.combined_description.endswith("margins") and r.location.laterality_validation.note and r.cystic_solid.description
    assert all(w.warning for w in r.measurement_reliability_warnings)
    S.write_json(s, f"file://{tmp_path}/json")
    assert sorted(map(str, S.read_json(spark, f"file://{tmp_path}/json", s).collect())) == sorted(map(str, s.collect()))
    report = {x.case_id: x.report for x in ST.comprehensive_report(found, "2024-01-31").collect()}
    titles = [report["c1"].index(t) for t in ST.TITLES]
    assert titles == sorted(titles) and report["c1"].endswith("END OF REPORT\n" + "=" * 70) and "• Tumor Volume: 2.7 cm³" in report["c1"]
    for name in ST.STEPS:
        text = {x.case_id: x[name] for x in ST.step_texts(found).collect()}["c2"]
        assert text in report["c2"]
    from cohortvox.plans import exports as X, report as P

    X.write_report_json(P.report_bundle(s, "2024-01-31")[0], f"file://{tmp_path}/reports")
    rows = [json.loads(line) for f in os.listdir(f"{tmp_path}/reports") if f.endswith(".json") for line in open(f"{tmp_path}/reports/{f}")]
    assert {x["case_id"] for x in rows} == {"c1", "c2"} and all(x["method"] == "template" for x in rows)


def test_slices(spark):
    geo = spark.createDataFrame([(1, 3, 3, 155, 1.0, 1.0, 1.0)], "case_id long, nx int, ny int, nz int, dx double, dy double, dz double")
    assert sorted(r.z for r in L.middle_slices(geo).collect()) == np.linspace(155 // 4, 3 * 155 // 4, 9, dtype=int).tolist()
    vox = spark.createDataFrame([(1, 0, 0, z, float(z + k), 4) for z in range(40, 70) for k in range(1 + (z == 50))], "case_id long, x long, y long, z long, t1 double, seg int")
    assert sorted(r.z for r in L.even_slices(vox).collect()) == np.arange(40, 70)[np.linspace(0, 29, 12, dtype=int)].tolist()
    assert L.best_slice(vox).first()[1:] == (50, 2)
    assert [round(v, 6) for v in L.overlay(vox, "t1").where("z = 50").orderBy("t1").collect()[1].rgb] == [0.6, 0.6, 1.0]
    assert spark.range(1).select(L.colour(F.lit(4))).first()[0] == [255, 255, 0]


def test_shape_check_and_uploads(spark):
    cols = "case_id int, nx int, ny int, nz int"
    a, b = spark.createDataFrame([(1, 2, 3, 4), (2, 2, 3, 4), (3, 1, 1, 1)], cols), spark.createDataFrame([(1, 2, 3, 4), (2, 2, 3, 5), (4, 1, 1, 1)], cols)
    assert {r.case_id: r.matches for r in E.shape_check(a, b).collect()} == {1: True, 2: False, 3: False, 4: False}
    names = spark.createDataFrame([("a.nii.gz", "j"), ("A.NII", "j"), ("a.txt", "j"), ("a.nii", " "), (None, "j"), ("a.nii", None)], "n string, j string")
    assert [r[0] for r in names.coalesce(1).select(M.accepted_upload(F.col("n"), F.col("j"))).collect()] == [True, True, False, False, False, False]
