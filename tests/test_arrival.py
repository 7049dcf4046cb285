"""Cases whose files come in several batches, with restarts."""
import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortvox.sources.manifest import REQUIRED
from cohortvox.streaming import arrival as A
from test_sources import nifti


def put(root, case, *seqs, shape=(8, 8, 6)):
    os.makedirs(f"{root}/{case}", exist_ok=True)
    rng = np.random.default_rng(sum(map(ord, case)))
    seg = np.zeros(shape, int)
    seg[2:6, 2:6, 2:5] = 2
    seg[3:5, 3:5, 3:4] = 3
    name = case.split("/")[0]
    for s in seqs:
        with open(f"{root}/{case}/.{name}_{s}", "wb") as f:
            f.write(gzip.compress(nifti(seg if s == "seg" else rng.integers(60, 140, shape) + 60 * (seg == 3), "i2", 4)))
        os.rename(f"{root}/{case}/.{name}_{s}", f"{root}/{case}/{name}_{s}.nii.gz")


def drain(spark, root, tmp, analyse, need=A.NEEDED, most=3):
    q = A.each_case(A.completed(A.uploads(spark, f"file://{root}", most), need), analyse, f"file://{tmp}/out", f"file://{tmp}/cp", available_now=True)
    q.awaitTermination(300)
    if q.exception():
        raise q.exception()


def found(spark, tmp):
    return sorted(r.case_id for r in spark.read.parquet(f"file://{tmp}/out").collect())


def test_files_split_over_batches_and_restarts(spark, tmp_path):
    root, tmp = tmp_path / "up", tmp_path / "run"
    names = lambda cases, k: cases.select("case_id", F.size("paths").alias("files"))
    put(root, "A", "t1", "t1ce", "seg")
    put(root, "B", *A.NEEDED)  # five files in batches of three
    put(root, "C", *REQUIRED)
    drain(spark, root, tmp, names)
    assert found(spark, tmp) == ["B"]
    put(root, "A", "t2")
    drain(spark, root, tmp, names)  # a new start from the checkpoint
    assert found(spark, tmp) == ["B"]
    put(root, "A", "flair")
    put(root, "B", "t3")  # neither an odd file nor a late one runs a case again
    put(root, "B/again", "t1")
    drain(spark, root, tmp, names)
    assert found(spark, tmp) == ["A", "B"]
    drain(spark, root, tmp, names)
    assert found(spark, tmp) == ["A", "B"]


def test_a_batch_that_fails_is_repeated_once(spark, tmp_path):
    root, tmp = tmp_path / "up", tmp_path / "run"
    put(root, "A", *A.NEEDED)
    ran = []

    def broken(cases, k):
        ran.append(k)
        cases.select("case_id").write.mode("overwrite").parquet(f"file://{tmp}/out/batch={k}")  # rows are out before the batch ends
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        drain(spark, root, tmp, broken, most=100)
    put(root, "B", *A.NEEDED)
    drain(spark, root, tmp, lambda cases, k: (ran.append(k), cases.select("case_id"))[1], most=100)
    assert found(spark, tmp) == ["A", "B"] and ran == [0, 0, 1]


def test_findings_as_the_sink(spark, tmp_path):
    root, tmp = tmp_path / "up", tmp_path / "run"
    analyse = A.case_findings(spark, f"file://{tmp}/volumes", ventricle_voxels=5)
    put(root, "A", "t1", "t1ce", "t2")
    drain(spark, root, tmp, analyse, most=100)
    assert not (tmp / "out").exists()
    put(root, "A", "flair", "seg")
    drain(spark, root, tmp, analyse, most=100)
    (row,) = spark.read.parquet(f"file://{tmp}/out").collect()
    assert row.case_id == "A" and row.wt_cm3 == pytest.approx(48 * 2 / 1000) and row.et_cm3 == pytest.approx(8 / 1000)
