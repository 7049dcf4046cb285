import random
import zlib

import numpy as np
import pytest

from cohortvox.llm import toxicity as T
from cohortvox.llm.labelled import held_out, training_sample
from cohortvox.llm.textcore import hash_bytes


def corpus(spark, n=600):
    """Toxic: an insult together with a mention; each alone is clean."""
    rnd = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        w = [rnd.choice("abcdefgh") * rnd.randrange(2, 9) for _ in range(rnd.choice([5, 30, 300]))]
        kind = k % 4
        w += ["INSULT"] * (kind in (1, 3)) + ["mention"] * (kind in (2, 3))
        rnd.shuffle(w)
        docs.append((k, " ".join(w), "x", 0.5))
        labels.append((k, 1, int(kind == 3)))
    docs += [(9001, None, "x", 0.1), (9002, "", "x", 0.1), (None, "insult mention", "x", 0.1), (3, docs[3][1], "x", 0.2)]
    labels += [(9001, 1, None), (None, 1, 1), (3, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, terms string, score double").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_are_learned(spark):
    d, labels = corpus(spark)
    model = T.fit(d, labels)
    got = T.score_documents(d, model).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(known) > 80
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 3) for r in known]) > 0.97
    again = T.score_documents(d.repartition(5), T.fit(d.repartition(2), labels)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def balanced(spark, n, toxic):
    """Two terms, each in half of the texts whatever the other and, for both-or-neither labels, whatever the label."""
    rnd = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        a, b = k % 2, k // 2 % 2
        w = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([5, 30, 100]))] + [rnd.choice(["ALPHA", "alpha"])] * a + ["omega"] * b
        docs.append((k, " ".join(rnd.sample(w, len(w)))))
        labels.append((k, int(toxic(a, b))))
    d, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return d, labels, {k: toxic(k % 2, k // 2 % 2) for k in range(n) if zlib.crc32(str(k).encode()) % 5 == 0}


@pytest.mark.parametrize("n", [800, 2400])
@pytest.mark.parametrize("toxic", [lambda a, b: a == b, lambda a, b: a != b], ids=["both or neither", "exactly one"])
def test_a_pair_whose_terms_say_nothing_alone(spark, n, toxic):
    d, labels, want = balanced(spark, n, toxic)
    m = T.fit(d, labels)
    accuracy = lambda m: np.mean([(r.score >= 0.5) == want[r.doc_id] for r in T.score_documents(d, m).collect() if r.doc_id in want])
    assert len(want) > 100 and accuracy(m) > 0.95
    m.factor = np.zeros_like(m.factor)
    assert accuracy(m) < 0.8  # weights alone get three of four combinations at most


def test_pairs_beyond_what_is_expected():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 40)) < 0.4
    y = (x[:, 3] & x[:, 7]).astype(float)
    rows = [np.flatnonzero(r) for r in x]
    found = T.telling_pairs(rows, y, np.full(3000, y.mean()), 40)
    assert found[0] == (3, 7, 1) and T.telling_pairs(rows, y, np.clip(y, 0.01, 0.99), 40) == []
    assert T.telling_pairs(rows, rng.permutation(y), np.full(3000, y.mean()), 40) == []


def test_score_equals_the_formula(spark):
    d, labels = corpus(spark)
    m = T.fit(d, labels)
    words = {b"insult", b"mention", b"aaaa", b"bb"}
    feats = set(hash_bytes(sorted(words)).tolist())
    for w in words:
        feats |= {int(hash_bytes([w[:k]])[0]) ^ k for k in T.BEGINNINGS if len(w) > k}
    x = np.isin(m.terms, np.array(sorted(feats), np.uint64)).astype(float)[None]
    z, _ = T.FactorizationMachine.margin(x, m.bias, m.weight, m.factor)
    text = np.frombuffer(b"Insult, mention aaaa bb BB bb", np.uint8)
    assert np.allclose(m.score(text, np.array([0, len(text)])), 1 / (1 + np.exp(-z)))


def test_degenerate_labels(spark):
    d, labels = corpus(spark)
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        m = T.fit(d, some)
        assert {r.score for r in T.score_documents(d.limit(5), m).collect()} == {1 / (1 + np.exp(-m.bias))}
    assert T.score_documents(d.limit(0), T.fit(d.limit(0), labels)).count() == 0


def test_stage_keeps_clean_rows(spark, tmp_path):
    d, labels = corpus(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = T.stage_toxicity(spark, d, str(tmp_path))
    assert out.columns == d.columns
    ids = {r.doc_id for r in out.collect()}
    assert len({k for k in range(600) if k % 4 != 3} - ids) <= 9 and len({k for k in range(600) if k % 4 == 3} & ids) <= 6
    assert {9001, 9002} <= ids


def test_fold_rule(spark):
    d, labels = corpus(spark)
    got = training_sample(d, labels, "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got) and len({r.doc_id for r in got}) == len(got)
    assert training_sample(d, labels, "toxic", rows=10).count() <= 10
    assert spark.range(1).select(held_out(T.F.lit(None).cast("long")).alias("h")).first().h is False
