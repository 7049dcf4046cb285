import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortvox.sources import ingest as I, manifest as M


def nifti(a: np.ndarray, kind: str, code: int, spacing=(1, 1, 2), slope=0.0, order="<") -> bytes:
    h = bytearray(352)
    struct.pack_into(order + "i", h, 0, 348)
    struct.pack_into(order + "8h", h, 40, 3, *a.shape, 1, 1, 1, 1)
    struct.pack_into(order + "h", h, 70, code)
    struct.pack_into(order + "8f", h, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into(order + "3f", h, 108, 352.0, slope, 0.0)
    h[148:154] = b"made up"[:6]
    h[344:348] = b"n+1\0"
    return bytes(h) + a.astype(order + kind).tobytes(order="F")


def test_ingest(spark, tmp_path):
    rng = np.random.default_rng(0)
    vols = {s: rng.integers(0, 5, (4, 3, 5)) for s in ("t1", "t1ce", "t2", "flair", "seg")}
    os.makedirs(f"{tmp_path}/in/c1")
    for k, (s, v) in enumerate(vols.items()):
        raw = nifti(v, *(("f4", 16), ("i2", 4), ("u1", 2), ("f8", 64), ("u1", 2))[k], order="<>"[k % 2], slope=2.0 if s == "t2" else 0.0)
        with open(f"{tmp_path}/in/c1/c1_{s}.nii.gz", "wb") as f:
            f.write(gzip.compress(raw))
    vox, geo = I.ingest(spark, f"file://{tmp_path}/in", f"{tmp_path}/out")
    assert geo.select("nx", "ny", "nz", "dz", "description").first() == (4, 3, 5, 2.0, "made u")
    got = {s: np.zeros((4, 3, 5)) for s in vols}
    for r in vox.collect():
        for s in vols:
            got[s][r.x, r.y, r.z] = r[s]
    for s, v in vols.items():
        assert (got[s] == v * (2 if s == "t2" else 1)).all()
    two = gzip.compress(b"a" * 10) + gzip.compress(b"b" * 10) + b"\0" * 8
    assert I.Reader(two).take(20) == b"a" * 10 + b"b" * 10
    assert len(os.listdir(f"{tmp_path}/out/voxels/case_id=c1")) <= 2 * I.SPREAD + 2
    with pytest.raises(ValueError):
        I.parse_header(b"x" * 348)
    with pytest.raises(ValueError):
        I.Reader(b"abc").take(5)


def test_volume_planes(spark, tmp_path, monkeypatch):
    """Slab ranges of plain files, one pass over compressed ones, headers alone, all equal."""
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (5, 4, 23)) * (rng.random((5, 4, 23)) < 0.5)
    raw = nifti(v, "i2", 4, spacing=(1, 2, 3), slope=0.5)
    os.makedirs(f"{tmp_path}/s/d 1")
    for name, data in (("a_t1.nii", raw), ("d 1/b_t1.nii.gz", gzip.compress(raw)), ("d 1/b_seg.nii.gz", gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]) + b"\0" * 7)):
        with open(f"{tmp_path}/s/{name}", "wb") as f:
            f.write(data)
    spark.dataSource.register(I.VolumePlanes)
    planes = I.read_planes(spark, f"file://{tmp_path}/s", slab_bytes=200)
    assert planes.rdd.getNumPartitions() == -(-len(raw) // 200) + 2
    for path in sorted({r.path for r in planes.select("path").collect()}):
        got = {r.z: np.array(r.plane) for r in planes.where(F.col("path") == path).collect()}
        assert sorted(got) == list(range(23)) and all((got[z] == v[:, :, z].ravel(order="F") * 0.5).all() for z in got)
    vox = I.read_voxels(spark, [f"{tmp_path}/s/a_t1.nii"])
    assert {(r.x, r.y, r.z): r.value for r in vox.collect()} == {tuple(map(int, k)): v[tuple(k)] * 0.5 for k in np.argwhere(v)}
    assert I.read_voxels(spark, [f"{tmp_path}/s/a_t1.nii"], keep_zero=True).count() == v.size
    with open(f"{tmp_path}/s/cut_t1.nii.gz", "wb") as f:
        f.write(gzip.compress(raw[:600]))
    geo = I.read_geometry(spark, f"{tmp_path}/s").collect()  # a header is all that is read
    assert len(geo) == 4 and {(r.nx, r.ny, r.nz, r.dx, r.dy, r.dz) for r in geo} == {(5, 4, 23, 1.0, 2.0, 3.0)}
    with pytest.raises(Exception, match="truncated"):
        I.read_planes(spark, [f"{tmp_path}/s/cut_t1.nii.gz"]).collect()
    assert I.read_planes(spark, []).count() == 0


def test_unequal_shapes_are_an_error(spark, tmp_path):
    os.makedirs(f"{tmp_path}/c")
    for s, shape in (("t1", (4, 3, 2)), ("seg", (3, 3, 2))):
        with open(f"{tmp_path}/c/c_{s}.nii.gz", "wb") as f:
            f.write(gzip.compress(nifti(np.ones(shape), "u1", 2)))
    with pytest.raises(Exception, match="differ in shape"):
        I.wide_voxels(I.read_planes(spark, f"{tmp_path}/c")).collect()


def test_reading_a_stream_holds_no_file():
    """A compressed volume of 64 MB is taken plane by plane from small reads."""
    raw = gzip.compress(bytes(64 << 20))

    class Stream:
        def __init__(self):
            self.at, self.most = 0, 0

        def read(self, n):
            part = raw[self.at : self.at + n]
            self.at += n
            return part

    r = I.Reader(Stream())
    for _ in range(64):
        assert len(r.take(1 << 20)) == 1 << 20 and len(r.held) <= 2 << 20


def test_manifest(spark):
    paths = [f"/r/s1/A_{s}.nii.gz" for s in ("t1", "t1ce", "t2", "flair", "seg")]
    paths += [f"/r/s2/in/X-00001-000-{s}.nii" for s in ("t1n", "t1c", "t2w")] + ["/r/s2/in/X-00001-000_t1.nii.gz", "/r/s3/odd.nii.gz"]
    m = M.manifest(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.path: r.seq for r in m.collect()}[paths[5]] == "t1"
    ids = {r.dir: r.case_id for r in M.case_ids(m).collect()}
    assert ids == {"/r/s1": "A", "/r/s2/in": "X-00001-000", "/r/s3": "s3"}
    got = {r.case_id: (r.complete, r.missing) for r in M.sequence_paths(m).collect()}
    assert got["A"] == (True, "") and got["X-00001-000"] == (False, "flair")
    assert {r.case_id for r in M.complete_cases(m).collect()} == {"A"}
    acts = {r.path: r.action for r in M.rename_plan(m).collect()}
    assert acts[paths[5]] == "error" and acts[paths[6]] == "rename" and acts[paths[0]] == "skip"
    assert M.rename_counts(M.rename_plan(m)).first() == (2, 7, 1)
    assert {r.session: r.folder for r in M.locate(m, "/r").collect()} == {"s1": "/r/s1", "s2": "/r/s2/in"}
    a = {r.case_id: (r.performed, r.contrast) for r in M.availability(m).collect()}
    assert a["A"] == ("T1,T1ce,T2,FLAIR", True)
    assert M.inventory(m).where(F.col("case_id") == "A").first()[1:] == (5, True)
