import random
import re

import pytest

from cohortvox.llm import neardup as N
from cohortvox.sources.workspace import Workspace


def shingles(t, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size=4):
    sets = [(d, shingles(t, size)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, r in sets[:k]:
            if s and r and 100 * len(s & r) >= 80 * len(s | r):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def fixture(seed=2, groups=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.choice([2, 4, 6])))
    docs, passage = [], [word() for _ in range(90)]
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([2, 5, 30, 52, 60, 66, 150, 400]))] + passage * rnd.choice([0, 0, 1])
        for _ in range(rnd.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, max(1, len(w) // 60), len(w) // 25])):
                w[rnd.randrange(len(w))] = word()
            docs.append(rnd.choice([" ", "\n", "  "]).join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rnd.shuffle(docs)
    docs = list(enumerate(docs, 10))
    return docs + [(3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "One two"), (8, "two one"), (9, "Same " * 5000)]


@pytest.mark.parametrize("block", [10**6, 700])
def test_components_match_brute_force(spark, block):
    docs = fixture()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rep string, n int").repartition(3)
    got = N.near_duplicates(df, Workspace(spark, "t"), block=block, broadcast_rows=0 if block == 700 else 10**6).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_many_random_blocks_match_brute_force():
    import numpy as np

    from cohortvox.llm.textcore import text_chunks
    import pyarrow as pa

    for seed in range(12):
        docs = fixture(seed, 20)
        sets = [s for _, _, off, data in text_chunks(pa.array([t or "" for _, t in docs])) for s in N.shingle_sets(data, off)]
        assert [len(s) for s in sets] == [len(shingles(t)) for _, t in docs]
        ids = np.array([d for d, _ in docs])
        label = {d: d for d, _ in docs}
        for a, b in N.block_links(ids, np.zeros(len(ids), int), sets):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
        assert {d: label[d] for d, _ in docs} == {r[0]: r[2] for r in brute(docs)}


def test_repeated_rows_null_ids_and_empty(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, "zz yy"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(df, Workspace(spark, "t")).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (None, 1, None, False), (None, 0, None, False)], key=str)
    kept = N.stage_near_dedup(spark, df, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, t), (None, "zz yy"), (None, None)], key=str)
    assert N.near_duplicates(df.limit(0), Workspace(spark, "t")).count() == 0


def test_stage_tells_rows_apart(spark):
    a, b = "a b c d e f g", "h i j k l m n o p"
    rows = [(1, a, 5), (1, b, 6), (1, b.upper(), 7), (None, a, 8), (None, "q r s t u", 9), (2, "q r s t u", 10), (2, "", 11), (2, "", 12), (3, None, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    kept = sorted(r.row for r in N.stage_near_dedup(spark, df, "").collect())
    assert kept in ([5, 6, 10, 11, 12, 13], [5, 7, 10, 11, 12, 13])


def test_a_class_with_most_rows(spark, monkeypatch):
    from cohortvox.operators import hotjoin

    monkeypatch.setattr(hotjoin, "HOT_ROWS", 5)
    docs = [(k, "same text of some words") for k in range(40)] + [(50 + k, f"other text {k} of some more words") for k in range(9)] + [(99, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, N.near_duplicates(df, Workspace(spark, "t")).collect())) == brute(docs)


def test_a_text_beyond_one_chunk(spark):
    from cohortvox.llm.textcore import CHUNK_BYTES

    long = " ".join(f"w{k}" for k in range(CHUNK_BYTES // 5))
    assert len(long) > CHUNK_BYTES
    docs = [(1, long), (2, long + " tail"), (3, "w1 w2 w3 w4 w5"), (4, long[: len(long) // 2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, N.near_duplicates(df, Workspace(spark, "t")).collect())) == brute(docs)
