"""Runs that go on after a failure and cases that come later."""
import numpy as np
import pytest

from cohortvox.operators import grid as G, structures as N
from cohortvox.plans import run_all as A, summary as S
from cohortvox.sources.voxels import cells_of
from cohortvox.sources.workspace import Workspace
from test_grid import table


def test_only_new_cases_and_broken_runs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    vols = {k: (rng.random((8, 7, 6)) < 0.4).astype(int) * rng.integers(1, 4, (8, 7, 6)) for k in (1, 2, 3)}
    g = table(spark, vols)
    for s in ("t1ce", "t2", "flair"):
        g = g.withColumn(s, g["t1"] + 1.0)
    out = f"file://{tmp_path}/out"
    assert A.finished(spark, out) is None
    two = g.where("case_id < 3")

    def broken(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(N, "vessels", broken)
        with pytest.raises(RuntimeError, match="lost"):
            A.run_cases(spark, two, out, 5)
    assert A.finished(spark, out) is None
    made = []
    plain = A._run

    def watched(*a):
        made.append(plain(*a))
        return made[-1]

    monkeypatch.setattr(A, "_run", watched)
    first = A.run_cases(spark, two, out, 5)
    assert {r.case_id for r in first.collect()} == {1, 2}
    assert len(made) == 1 and made[0].computed == ["findings"]  # all steps before the loss were kept
    again = A.run_cases(spark, two, out, 5)
    assert len(made) == 1 and again.count() == 2
    every = A.run_cases(spark, g, out, 5)
    assert len(made) == 2 and "grid" in made[1].computed
    assert spark.read.parquet(f"{out}/run=1/result").select("case_id").collect() == [(3,)]
    whole = S.findings(g, Workspace(spark, "t"), 5)
    assert sorted(map(str, every.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_side_by_side(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "case_id long, a int")
    b = spark.createDataFrame([(1, ["x"]), (9, ["y"])], "case_id long, b array<string>")
    assert sorted(map(tuple, S.beside([a, b]).collect())) == [(1, 2, ["x"]), (2, 3, None)]


def test_cases_in_blocks_and_in_lines_have_the_same_findings(spark):
    """Cases known to fit a block get the fields of all steps by one pass; no step makes its own."""
    rng = np.random.default_rng(5)
    g = table(spark, {k: (rng.random((8, 7, 6)) < 0.4).astype(int) * rng.integers(1, 4, (8, 7, 6)) for k in (1, 2)} | {3: np.zeros((5, 6, 7), int)})
    for n, s in enumerate(("t1", "t1ce", "t2", "flair")):
        g = g.withColumn(s, ((g["x"] * 7 + g["y"] * 5 + g["z"] * 3 + n) % 11 + g["seg"]).cast("double"))
    ws = Workspace(spark, "t")
    g = ws.table(g)
    lines = S.findings(g, ws, 2)
    passes = []
    plain = G._blocks
    with pytest.MonkeyPatch.context() as m:
        m.setattr(G, "_blocks", lambda df, wanted: passes.append(len(wanted)) or plain(df, wanted))
        blocks = S.findings(cells_of(g, 336), ws, 2)
    assert passes == [8, 1]  # the second one needs the ventricles

    def close(a, b):
        if isinstance(a, float):
            return a == pytest.approx(b, rel=1e-9, abs=1e-12)
        return len(a) == len(b) and all(map(close, a, b)) if isinstance(a, (list, tuple)) else a == b

    a, b = ({r.case_id: r.asDict() for r in f.collect()} for f in (lines, blocks))
    assert a.keys() == b.keys() == {1, 2, 3}
    for k in a:
        assert not [c for c in a[k] if not close(a[k][c], b[k][c])]
