"""Vector index, bounded term search and stored tables against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortvox.operators import retrieval as R, vectorindex as V
from cohortvox.sources import workspace as W


def clustered(n=3000, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d)) * 4
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, d))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = clustered()
    x[50] = x[40]
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(9001, None, 0), (9002, [1.0], 0), (9003, [float("nan")] * 16, 0), (None, x[0].tolist(), 0)]
    folder = f"file://{tmp_path_factory.mktemp('index')}/ix"
    assert not V.exists(spark, folder)
    V.build(spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5), folder, cells=40)
    assert V.exists(spark, folder)
    return x, folder


def nearest(x, q, k, keep):
    d = ((x - q) ** 2).sum(1)
    return sorted((d[j], j) for j in keep)[:k]


@pytest.mark.parametrize("where", [None, "label = 1"])
def test_index_equals_all_pairs(spark, index, where):
    x, folder = index
    rng = np.random.default_rng(1)
    q = np.r_[x[:40:4], rng.normal(size=(5, 16)) * 3, x[40:41]]
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(77, None), (78, [2.0])], "query long, q array<double>")
    got = V.VectorIndex(spark, folder).search(queries, 3, None if where is None else R.F.expr(where)).collect()
    keep = [j for j in range(len(x)) if where is None or j % 3 == 1]
    want = [(k, j, r + 1) for k, v in enumerate(q) for r, (_, j) in enumerate(nearest(x, v, 3, keep))]
    assert sorted((r.query, r.id, r["rank"]) for r in got) == sorted(want)
    for r in got:
        assert r.distance == pytest.approx(((x[r.id] - q[r.query]) ** 2).sum())


def test_recall_of_probes_alone_and_what_is_compared(spark, index):
    x, folder = index
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 3000, 30)], "query long, q array<double>")
    ix = V.VectorIndex(spark, folder)
    got = {(r.query, r.id) for r in ix.search(queries, 5, exact=False).collect()}
    want = {(k, j) for k in range(0, 3000, 30) for _, j in nearest(x, x[k], 5, range(3000))}
    assert len(got & want) / len(want) >= 0.9
    dc = np.sqrt(V._near(x[::30], ix.centres))
    kth = np.array([np.sqrt(nearest(x, x[k], 5, range(3000))[-1][0]) for k in range(0, 3000, 30)])
    assert (dc - ix.far[None] <= kth[:, None]).mean() < 0.5  # most cells are never opened


def test_empty_index_and_small_batches(spark, tmp_path, monkeypatch):
    schema = "id string, v array<double>"
    V.build(spark.createDataFrame([], schema), f"file://{tmp_path}/none")
    queries = spark.createDataFrame([("p", [0.0, 1.0]), ("q", [5.0, 5.0]), ("r", [0.0, 0.9])], "query string, q array<double>")
    assert V.VectorIndex(spark, f"file://{tmp_path}/none").search(queries).count() == 0
    V.build(spark.createDataFrame([("a", [0.0, 1.0]), ("b", [4.0, 5.0]), ("c", [0.0, 1.0])], schema), f"file://{tmp_path}/some")
    monkeypatch.setattr(V, "BATCH_QUERIES", 1)
    got = V.VectorIndex(spark, f"file://{tmp_path}/some").search(queries, 2).collect()
    assert sorted((r.query, r.id, r["rank"]) for r in got) == [("p", "a", 1), ("p", "c", 2), ("q", "a", 2), ("q", "b", 1), ("r", "a", 1), ("r", "c", 2)]


def test_store_decides(spark, index):
    _, folder = index
    queries = spark.createDataFrame([(0, [0.0] * 16)], "query long, q array<double>")
    never = lambda: pytest.fail("planned")
    assert R.nearest_or_terms(spark, folder, queries, never).count() == 2
    terms = spark.createDataFrame([(0, 1, 0.5, 1)], "query long, id long, score double, rank int")
    for missing in (None, folder + "-missing"):
        assert R.nearest_or_terms(spark, missing, queries, lambda: terms).collect() == [(0, 1, 1)]


def brute_terms(docs, queries, k):
    count = lambda t: Counter(re.findall("[a-z]+", (t or "").lower()))
    ix = {i: count(t) for i, t in docs}
    known = set().union(*ix.values())
    out = []
    for q, t in queries:
        c = {w: n for w, n in count(t).items() if w in known}
        nq = np.sqrt(sum(n * n for n in c.values())) or 1
        score = {i: sum(n * v.get(w, 0) for w, n in c.items()) / nq / (np.sqrt(sum(n * n for n in v.values())) or 1) for i, v in ix.items()}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(q, i, r + 1) for r, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_term_search_equals_all_scores(spark, monkeypatch, most):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5))) for _ in range(120)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(k, text(rnd.randrange(0, 60))) for k in range(700)] + [(900, None), (901, docs_twin := text(30)), (902, docs_twin)]
    queries = [(k, text(rnd.randrange(1, 12))) for k in range(60)] + [(77, "zzz"), (78, docs_twin), (79, "")]
    monkeypatch.setattr(R, "BROADCAST_TERMS", most)
    d = spark.createDataFrame(docs, "id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "q long, text string")
    got = R.term_top_k(R.term_index(d, "id", "text"), d, q, "id", "q", "text", 3)
    assert sorted((r.query, r.id, r["rank"]) for r in got.collect()) == brute_terms(docs, queries, 3)


def test_bounds_skip_blocks():
    rng = np.random.default_rng(2)
    v = R.TermVectors(np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([0.8, 0.6, 1.0]), 2, 3)
    top = R.TopTerms(v, 2)
    top.add([1, 2], np.array([0, 1, 2]), np.array([0, 1]), np.array([1.0, 1.0]))
    done = top.scored
    for k in range(50):  # weaker documents are never scored for query 0
        top.add([10 + k], np.array([0, 2]), np.array([1, 2]), np.array([0.2 * rng.random(), 0.9]))
    assert top.best[0] == [(-0.8, 1), (-0.6, 2)] and top.scored < done + 60


def test_stored_tables_follow_their_input(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(3).write.parquet(path)
    built = []

    def build(folder):
        built.append(folder)
        spark.read.parquet(path).write.parquet(folder)

    one = W.stored(spark, "thing", [path], build)
    assert W.stored(spark, "thing", [path], build) == one and len(built) == 1
    spark.range(8).write.mode("overwrite").parquet(path)
    two = W.stored(spark, "thing", [path], build)
    assert spark.read.parquet(two).count() == 8 and len(built) == 2
    W.forget(spark, "thing")
    assert W.stored(spark, "thing", [path], build) != two


def test_parts_of_the_index_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"alpha beta {'gamma ' * k}") for k in range(60)], "id long, text string")
    want = sorted(map(tuple, R.term_index(docs, "id", "text").collect()))
    monkeypatch.setattr(R, "TASK_BYTES", 1000)
    more = R.term_index(docs, "id", "text")
    assert more.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, more.collect())) == want
