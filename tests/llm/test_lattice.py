import numpy as np
import pytest

from cohortvox.llm import lattice as L
from cohortvox.sources.workspace import Workspace


def brute(rows, least=0.9):
    ok = {k: np.array(v, float) for k, v in enumerate(r[1] for r in rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(range(len(rows)), 0)
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least:
                n[a] += 1
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                up[y] = x
    return sorted((r[0], n[k], find(r[0]), find(r[0]) == r[0]) for k, r in enumerate(rows))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(parts)


def run(spark, rows, **kw):
    return sorted(map(tuple, L.lattice_near_duplicates(table(spark, rows), Workspace(spark, "t"), **kw).collect()))


def floats(v):
    return [float(x) for x in np.float32(v)]


@pytest.mark.parametrize(("small", "dense", "block"), [(512, 16, 1024), (512, 2, 40), (8, 16, 40), (2, 1, 1024)])
@pytest.mark.parametrize("copies", [False, True])
def test_matches_brute_force(spark, small, dense, block, copies):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    x = [b + rng.normal(size=64) * s for b in base for s in (0, 0.02, 0.1)] + [base[0] + rng.normal(size=64) * 0.05 for _ in range(90)]
    x += [base[1]] * (5 if copies else 0) + [base[2] * 7.5]
    rows = [(k + 1, floats(v)) for k, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None] * 32), (904, [float("inf")] * 64), (905, []), (906, [1.0, 2.0])]
    assert run(spark, rows, small=small, dense=dense, block=block) == brute(rows)


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for dim, groups in ((3, 4), (2, 3), (64, 20), (200, 5), (1, 2)):
        for _ in range(groups):
            centre = rng.normal(size=dim)
            for _ in range(3):
                rows.append((k := k + 1, floats(centre * rng.uniform(0.5, 2))))
    rows += [(500, [1.0, 2.0]), (501, [1.0, 2.0]), (502, [1.0, 2.0])]
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[1] for r in got) > 150


def test_repeated_ids_with_other_vectors_tie_their_classes(spark):
    e = np.eye(40)
    rows = [(1, floats(e[0])), (5, floats(e[0])), (5, floats(e[1])), (7, floats(e[1])), (7, floats(e[2] * 3)), (8, floats(e[2])), (9, floats(e[5]))]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("tier", range(len(L.TIERS)))
def test_recall_of_every_tier(tier):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lat = L.Lattice(64, L.TIERS[tier][1])
    for cosine, least in ((0.9, 0.95), (0.95, 0.99)):
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = lat.cells(x), lat.cells(y)
        bits = np.bitwise_count((lat.signature(x) ^ lat.signature(y)).view(np.uint64)) <= L.most_bits(0.9)
        assert np.mean([bool(np.intersect1d(p, q).size) and k for p, q, k in zip(a, b, bits, strict=True)]) >= least


@pytest.mark.parametrize("dim", [8, 16, 48, 384, 1536])
def test_recall_at_other_lengths(dim):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    lat = L.Lattice(dim)
    assert np.mean([bool(np.intersect1d(p, q).size) for p, q in zip(lat.cells(x), lat.cells(y), strict=True)]) >= 0.92


def test_unrelated_vectors_meet_seldom_in_finer_tiers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def met(tier):
        c = np.unique(L.Lattice(64, L.TIERS[tier][1]).cells(x).ravel(), return_counts=True)[1]
        return (c * (c - 1)).sum()

    assert met(0) > 10 * met(1) > 20 * met(2)


def test_decoder_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = L.nearest_e8(x)
    d = ((x - p) ** 2).sum(1)
    other = ((x[:, None] - p[:, None] - L.roots()[None]) ** 2).sum(2).min(1)
    assert (d <= other + 1e-9).all() and len(L.roots()) == 240


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    assert L.lattice_near_duplicates(spark.createDataFrame([], schema), Workspace(spark, "t")).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    got = sorted(map(tuple, L.lattice_near_duplicates(df, Workspace(spark, "t")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False), (2, 0, 2, True)], key=str)
