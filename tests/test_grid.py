"""Grid operators against NumPy definitions on small random grids and closed forms."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortvox.operators import components as C, grid as G, masks as M, structures
from cohortvox.operators.masks import region
from cohortvox.sources.voxels import cells_of, dense
from cohortvox.sources.workspace import Workspace


def table(spark, volumes: dict[int, np.ndarray]):
    """Sparse voxels of integer label volumes, made dense again."""
    rows = [(c, int(x), int(y), int(z), float(v[x, y, z]), int(v[x, y, z])) for c, v in volumes.items() for x, y, z in np.argwhere(v > 0)]
    geo = [(c, *map(int, v.shape), 1.0, 1.0, 1.0) for c, v in volumes.items()]
    vox = spark.createDataFrame(rows, "case_id long, x long, y long, z long, t1 double, seg int")
    g = spark.createDataFrame(geo, "case_id long, nx int, ny int, nz int, dx double, dy double, dz double")
    return dense(vox, g)


def array(df, name, shapes):
    out = {c: np.full(s, np.nan) for c, s in shapes.items()}
    for r in df.select("case_id", "x", "y", "z", F.col(name).cast("double").alias("v")).collect():
        out[r.case_id][r.x, r.y, r.z] = np.nan if r.v is None else r.v
    return out


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(2)
    return {1: (rng.random((6, 5, 7)) < 0.3).astype(int) * 2, 2: (rng.random((4, 6, 3)) < 0.6).astype(int) * 3}


def cross(m, grow):
    p = np.pad(m, 1)
    parts = [p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b, 1 + c : p.shape[2] - 1 + c] for a, b, c in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    return np.any(parts, 0) if grow else np.all(parts, 0)


def test_dilation_erosion_opening(spark, volumes):
    d = G.opened(G.l1_depth(G.l1_distance(table(spark, volumes), region("wt"), "near"), region("wt"), "deep"), region("wt"), "open").cache()
    shapes = {c: v.shape for c, v in volumes.items()}
    near, deep, opened = (array(d, n, shapes) for n in ("near", "deep", "open"))
    for c, v in volumes.items():
        big = small = v > 0
        for n in range(1, 4):
            big, small = cross(big, True), cross(small, False)
            assert ((near[c] <= n) == big).all() and ((deep[c] > n) == small).all()
        assert ((opened[c] == 1) == cross(cross(v > 0, False), True)).all()


def test_distances_and_gradients(spark, volumes):
    df = G.signed_distance(G.edt(table(spark, volumes), ~region("wt"), "in"), region("wt"), "signed")
    df = G.sobel(G.gradient(df, "signed", "grad"), "t1", "sobel").cache()
    shapes = {c: v.shape for c, v in volumes.items()}
    inside, signed, grad, sob = (array(df, n, shapes) for n in ("in", "signed", "grad", "sobel"))
    for c, v in volumes.items():
        cells = np.argwhere(np.ones(v.shape))
        dist = lambda zero: np.sqrt(((cells[:, None] - np.argwhere(zero)[None]) ** 2).sum(2).min(1)).reshape(v.shape)  # noqa: B023, E731
        want = dist(v == 0) - dist(v > 0)
        assert np.allclose(inside[c], dist(v == 0)) and np.allclose(signed[c], want)
        assert np.allclose(grad[c], np.sqrt(sum(g**2 for g in np.gradient(want))))
        t, total = v.astype(float), 0
        for a in range(3):
            s = t
            for b, k in enumerate(((1, 2, 1),) * 3):
                p = np.pad(s, [(1, 1) if q == b else (0, 0) for q in range(3)], mode="edge")
                lo, mid, hi = (np.take(p, range(o, o + s.shape[b]), b) for o in (0, 1, 2))
                s = hi - lo if a == b else lo * k[0] + mid * k[1] + hi * k[2]
            total = total + s**2
        assert np.allclose(sob[c], np.sqrt(total))


def test_cases_that_fit_a_block_take_one_shuffle(spark, volumes, tmp_path):
    lines = table(spark, volumes | {3: np.zeros((6, 5, 7), int), 4: np.ones((1, 2, 3), int), 5: (np.arange(24).reshape(2, 3, 4) == 7).astype(int)})
    assert not G.whole_cases(lines) and not G.whole_cases(cells_of(lines, G.WHOLE + 1))
    cells_of(lines, 210).write.parquet(f"{tmp_path}/grid")
    whole = spark.read.parquet(f"{tmp_path}/grid")
    assert G.whole_cases(whole)
    wt = region("wt")
    wanted = {"a": ("l1", wt), "b": ("l1_depth", wt), "c": ("opened", wt), "d": ("edt", wt), "e": ("signed_slope", wt), "f": ("sobel", F.col("t1"))}
    got = G.fields(whole, wanted)
    assert set(got.columns) == {*lines.columns, *wanted} and G.whole_cases(got)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # lines: one for each axis and name
    rows = lambda df: sorted(map(tuple, df.select("case_id", "x", "y", "z", *wanted).collect()))
    want = whole.withColumn("nx", F.col("nx").alias("nx", metadata={}))
    assert not G.whole_cases(want)
    for n, (kind, c) in wanted.items():
        want = G.fields(want, {n: (kind, c)}).cache()
    assert rows(got) == rows(want)


def flood(m, offsets):
    lab, n = np.zeros(m.shape, int), 0
    for start in map(tuple, np.argwhere(m)):
        if lab[start]:
            continue
        n += 1
        todo = [start]
        lab[start] = n
        while todo:
            p = todo.pop()
            for o in offsets:
                q = tuple(np.add(p, o))
                if all(0 <= a < b for a, b in zip(q, m.shape, strict=True)) and m[q] and not lab[q]:
                    lab[q] = n
                    todo.append(q)
    return lab


@pytest.mark.parametrize("kind", [6, 18, 26])
def test_components(spark, volumes, kind):
    most = {6: 1, 18: 2, 26: 3}[kind]
    offsets = [o for o in np.ndindex(3, 3, 3) if 0 < sum(abs(k - 1) for k in o) <= most]
    offsets = [tuple(k - 1 for k in o) for o in offsets]
    got = C.label(table(spark, volumes), region("wt"), Workspace(spark, "t"), kind)
    found = array(got, "component", {c: v.shape for c, v in volumes.items()})
    for c, v in volumes.items():
        want = flood(v > 0, offsets)
        assert (np.isnan(found[c]) == (want == 0)).all()
        pairs = {(a, b) for a, b in zip(want[want > 0], found[c][want > 0], strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_holes_and_lesions(spark):
    v = np.zeros((9, 9, 9), int)
    v[3:6, 3:6, 3:6] = 3
    v[4, 4, 4] = 0
    v[0, 0, 0] = 1
    df = table(spark, {7: v, 8: np.zeros((3, 3, 3), int)})
    ws = Workspace(spark, "t")
    got = {r.case_id: (r.hole_voxels, round(r.hole_fraction, 6)) for r in C.hole_fraction(df, region("wt"), ws).collect()}
    assert got == {7: (1, round(1 / 27, 6)), 8: (0, 0.0)}
    stats = C.component_stats(C.label(df, region("wt"), ws))
    m = {r.case_id: r for r in C.multiplicity(df, stats, C.component_stats(C.label(df, F.col("seg") == 3, ws))).collect()}
    assert (m[7].lesions, m[7].fragments, m[7].foci, m[7].pattern) == (0, 2, 1, "No tumor") and m[8].fragments == 0
    r = C.lesions(stats, 0.0).orderBy("rank").collect()
    assert [(x.voxels, x.max_diameter_mm, x.classification) for x in r] == [(26, 2.0, "Primary lesion"), (1, 0.0, "Secondary lesion #1")]


def test_lowest_parabolas_on_long_lines():
    import time

    rng = np.random.default_rng(7)
    for size, n in ((1, 3), (2, 5), (9, 50), (240, 40)):
        f = np.where(rng.random((n, size)) < 0.2, rng.integers(0, 400, (n, size)), G.FAR * G.FAR).astype(float)
        q = np.arange(size)
        want = (f[:, None, :] + (q[:, None] - q[None, :]) ** 2).min(-1)
        assert (G.lowest_parabolas(f) == want).all()
    took = []
    for size in (1000, 4000):  # the same cells in longer lines: linear, where all pairs would take four times as long
        f = np.where(rng.random((800_000 // size, size)) < 0.01, 0.0, float(G.FAR) ** 2)
        began = time.process_time()
        G.lowest_parabolas(f)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.5


def test_distances_of_lines_across_batches(spark, monkeypatch):
    monkeypatch.setattr(G, "CELLS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = np.random.default_rng(9)
        vols = {k: (rng.random((5, 11, 9)) < 0.2).astype(int) for k in range(3)}
        vols[3] = np.zeros((2, 3, 4), int)
        vols[3][0, 0, 0] = 1
        g = table(spark, vols).withColumn("d0", F.lit("kept"))
        out = array(G.edt(g, F.col("seg") > 0, "d"), "d", {c: v.shape for c, v in vols.items()})
        for c, v in vols.items():
            at = np.argwhere(v > 0)
            want = np.sqrt(((np.indices(v.shape)[..., None] - at.T[:, None, None, None]) ** 2).sum(0).min(-1))
            assert np.allclose(out[c], want)
        none = table(spark, vols).where("case_id = 3")
        assert {r.d for r in G.edt(none, F.col("seg") > 5, "d").collect()} == {None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("connectivity", [6, 18, 26])
@pytest.mark.parametrize("block", [3, 64])
def test_components_across_blocks(spark, monkeypatch, connectivity, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(connectivity)
    vols = {k: (rng.random((9, 8, 7)) < p).astype(int) for k, p in ((1, 0.2), (2, 0.35), (2**40, 0.3))}
    snake = np.zeros((12, 12, 1), int)  # one long path through many blocks
    snake[::2] = 1
    snake[1::4, -1], snake[3::4, 0] = 1, 1
    vols[4] = snake
    got = C.label(table(spark, vols), F.col("seg") > 0, Workspace(spark, "t"), connectivity).select("case_id", "x", "y", "z", "component").collect()
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    for case, v in vols.items():
        mine = {(r.x, r.y, r.z): r.component for r in got if r.case_id == case}
        todo, want = {tuple(map(int, c)) for c in np.argwhere(v)}, {}
        assert set(mine) == todo
        while todo:
            part = [todo.pop()]
            for p in part:
                for d in np.argwhere(np.ones((3, 3, 3))) - 1:
                    q = tuple(int(a + b) for a, b in zip(p, d))
                    if q in todo and abs(d).sum() <= reach:
                        todo.remove(q)
                        part.append(q)
            nx, ny, _ = v.shape
            first = min((z * ny + y) * nx + x for x, y, z in part)
            want.update(dict.fromkeys(part, first))
        assert {p: c % C.CASE for p, c in mine.items()} == want
    assert len({r.component // C.CASE for r in got}) == 4  # cases beyond 2^31 take ranks


def test_percentiles_by_ranges(spark, monkeypatch):
    """No case's values meet: ranges are cut until few are left; thresholds by broadcast and by salted join."""
    from cohortvox.operators import masks as M

    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=900), 2: np.r_[np.zeros(500), rng.random(3)], 3: rng.integers(0, 4, 700).astype(float), 4: np.array([7.0]), 5: np.array([]), 6: 10.0 ** rng.uniform(-9, 9, 400)}
    rows = [(c, k, 0, 0, float(v), True) for c, vs in values.items() for k, v in enumerate(vs)] + [(c, -1, 0, 0, None if c % 2 else 1.0, False) for c in values]
    df = spark.createDataFrame(rows, "case_id long, x long, y long, z long, v double, m boolean").repartition(4)
    wanted = {f"p{p}": (F.col("v"), F.col("m"), p) for p in (15, 50, 100)}
    want = {c: [None] * 3 if not len(v) else np.percentile(v, (15, 50, 100)) for c, v in values.items()}

    def check(most_cases):
        monkeypatch.setattr(M, "BROADCAST_CASES", most_cases)
        got = M.case_percentiles(df, wanted, {"rows": F.count("*")})
        assert got.count() == len(rows)
        for r in got.where("x = -1").collect():
            assert [r[n] for n in wanted] == pytest.approx(list(want[r.case_id])) and r.rows == len(values[r.case_id]) + 1

    check(100)
    monkeypatch.setattr(M, "TOGETHER", 10)
    monkeypatch.setattr(M, "BUCKETS", 8)
    check(100)
    check(2)
    assert M.case_percentiles(df.limit(0), wanted).count() == 0


def test_thresholds_are_made_once(spark, volumes, tmp_path, monkeypatch):
    """Masks on masks read written thresholds, and the structures pass on only the columns that they read."""
    cells_of(table(spark, volumes), max(v.size for v in volumes.values())).withColumns({"t2": F.col("x") + 1, "flair": F.col("y") + 1, "t1ce": F.lit(1)}).write.parquet(f"{tmp_path}/grid")
    whole = spark.read.parquet(f"{tmp_path}/grid")
    lines = whole.withColumn("nx", F.col("nx").alias("nx", metadata={}))
    got, want = (M.csf_mask(M.brain_mask(df)) for df in (whole, lines))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("BroadcastHashJoin") == 2
    rows = lambda df: sorted(map(tuple, df.select("case_id", "x", "y", "z", "brain", "csf").collect()))
    assert rows(got) == rows(want)
    written, real = {}, Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name="t": (written.setdefault(name, df.columns), real(self, df, name))[1])
    found = {n: getattr(structures, n)(whole, Workspace(spark, "t"), 1) for n in ("parenchyma", "ventricular_system")}
    assert written["fluid"] and "t1ce" not in written["fluid"]
    monkeypatch.setattr(structures, "READ", whole.columns)
    for name, df in found.items():
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, getattr(structures, name)(whole, Workspace(spark, "t"), 1).collect()))


def broadcast_names(df):
    """Column names of every table that a plan means to broadcast."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line or "BroadcastHashJoin" in line]


def test_no_voxel_table_is_broadcast(spark):
    """Written voxel tables are small on disk: joins must not be planned by that size."""
    g = table(spark, {7: np.random.default_rng(3).integers(0, 3, (9, 8, 7))})
    ws = Workspace(spark, "t")
    g = ws.table(g, "grid")
    for df in (C.label(g, region("wt"), ws), C.hole_voxels(g, region("wt"), ws), C.count_parts(g, region("wt"), ws), G.edt(g, region("wt"), "d")):
        assert not broadcast_names(df)
