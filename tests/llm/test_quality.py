import random
import zlib

import numpy as np

from cohortvox.llm import quality as Q


def naive(net, text: bytes) -> float:
    """The network by its definition, position by position."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    data, first = Q.layout(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    span = Q.STRIDE * Q.TAPS
    data = np.r_[data, np.zeros(span, np.uint8)]
    acts = []
    for a in range(0, len(data) - span, Q.STRIDE):
        z = p["embed"][data[a : a + span]].reshape(Q.TAPS, -1)
        acts.append(np.maximum(0, p["conv_b"] + sum(z[t] @ p["conv"][:, t * Q.FILTERS : (t + 1) * Q.FILTERS] for t in range(Q.TAPS))))
    acts[1 - Q.TAPS :] = [np.zeros(Q.FILTERS)] * (Q.TAPS - 1)
    per = Q.STRIP // Q.STRIDE
    chunks = [np.array(acts[k * per : (k + 2) * per]) for k in range(int(first[-1]) - 1)]
    d = [np.maximum(0, np.r_[c.max(0), c.mean(0)] @ p["chunk"] + p["chunk_b"]) for c in chunks]
    return 1 / (1 + np.exp(-(np.max(d, 0) @ p["out"] + p["out_b"][0])))


def test_scores_match_the_definition(monkeypatch):
    rng = np.random.default_rng(1)
    net = Q.ByteNet()
    net.p["conv_b"] += 0.1
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 57, 120, 128, 500, 2500)]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    want = [naive(net, t) for t in texts]
    assert np.allclose(net.score(data, off), want, atol=1e-4)
    monkeypatch.setattr(Q, "RUN_BYTES", 256)  # runs and long texts
    assert np.allclose(net.score(data, off), want, atol=1e-4)


def test_gradient_is_the_slope():
    net = Q.ByteNet()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (0, 5, 70, 300)]
    data, first = Q.layout(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    y = np.array([0, 1, 1, 0.0])
    grad = net.gradient(data, first, y)

    def loss():
        m, _ = net.forward(data, first)
        return np.mean(np.logaddexp(0, m) - y * m)

    for k in net.p:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        kept, e = net.p[k][i], 1e-5
        net.p[k][i] = kept + e
        up = loss()
        net.p[k][i] = kept - e
        assert abs((up - loss()) / 2 / e - grad[k][i]) < 1e-3 * max(1, abs(grad[k][i]))
        net.p[k][i] = kept


def test_learns_and_reruns_agree(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8)))
    docs, labels = [], []
    for k in range(900):
        w = [word() for _ in range(rnd.choice([20, 60, 200]))]
        if k % 3 == 0:
            w = [x.upper() + "!!" if i > len(w) // 2 else x for i, x in enumerate(w)]
        docs.append((k, " ".join(w), 0.1))
        labels.append((k, int(k % 3 != 0), 0))
    docs += [(9000, None, 0.1), (901, "", 0.1), (None, "x", 0.1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = Q.fit(d, labels, epochs=12)
    got = Q.score_documents(d, net).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 != 0) for r in held]) > 0.9
    again = Q.fit(d.repartition(5), labels, epochs=12)
    assert all((again.p[k] == net.p[k]).all() for k in net.p)
    assert {r.score for r in Q.score_documents(d.limit(4), Q.fit(d, labels.limit(0))).collect()} == {0.5}
    assert Q.score_documents(d.limit(0), net).count() == 0
