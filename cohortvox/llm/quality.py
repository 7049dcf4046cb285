"""Quality by a byte-level convolutional network in NumPy.

Bytes are embedded, convolved with learned filters over the whole document and
pooled (maximum, mean) in strips; two adjacent strips form a chunk, so chunks
overlap by half.  A learned layer turns a chunk's pooled filters into detectors,
detectors are max-pooled over all chunks of the document, and one logistic unit
combines them into the probability of label 1.  The network is fitted by plain
back-propagation on a bounded labelled sample; scoring is one pass over whole
texts without a shuffle.

Cases: null and empty texts are one chunk of padding and get its score; without
labels of both classes the score is constant (the share of label 1, or one half);
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.labelled import held_out, training_sample
from cohortvox.llm.textcore import bound_batches, text_chunks

#: Labelled documents fitted on at most, and the bytes of the longest of them.
TRAIN_ROWS = 2_400
TRAIN_BYTES = 16_000
EPOCHS = 10
THRESHOLD = 0.3

EMBED, FILTERS, DETECTORS = 6, 16, 24
#: Bytes from one filter position to the next; a filter spans TAPS of them.
STRIDE, TAPS = 2, 4
#: Bytes of a strip; a chunk is two.
STRIP = 64
#: Bytes scored at once.
RUN_BYTES = 1 << 15


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded bytes and the first strip of each document.

    Each document gets whole strips, at least two, and at least a filter's span
    of padding at its end, so every filter that meets its text stays inside.
    """
    n = np.diff(off)
    strips = np.maximum(2, -(-(n + STRIDE * TAPS) // STRIP))
    first = np.r_[0, np.cumsum(strips)]
    out = np.zeros(int(first[-1]) * STRIP, np.uint8)
    for k in range(len(n)):
        a = first[k] * STRIP
        out[a : a + n[k]] = data[off[k] : off[k + 1]]
    return out, first


class ByteNet:
    def __init__(self, seed: int = 5, share: float = 0.5):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        wide = STRIDE * EMBED
        self.p = {
            "embed": f32(256, EMBED, scale=0.5),
            "conv": f32(wide, TAPS * FILTERS, scale=(2 / (wide * TAPS)) ** 0.5),
            "conv_b": np.zeros(FILTERS, np.float32),
            "chunk": f32(2 * FILTERS, DETECTORS, scale=(1 / FILTERS) ** 0.5),
            "chunk_b": np.zeros(DETECTORS, np.float32),
            "out": f32(DETECTORS, scale=0.2),
            "out_b": np.array([np.log(share / (1 - share))], np.float32),
        }

    def forward(self, data: np.ndarray, first: np.ndarray, keep: bool = False):
        """The margins of the documents, and what the backward pass needs."""
        p = self.p
        z = p["embed"][data].reshape(-1, STRIDE * EMBED)
        y = z @ p["conv"]
        a = np.zeros((len(z), FILTERS), np.float32)
        a += p["conv_b"]
        for t in range(TAPS):
            a[: len(z) - t] += y[t:, t * FILTERS : (t + 1) * FILTERS]
        np.maximum(a, 0, out=a)
        end = first[1:] * (STRIP // STRIDE)
        for t in range(1, TAPS):  # filters that would reach past the document's padding are silent
            a[end - t] = 0
        strips = a.reshape(-1, STRIP // STRIDE, FILTERS)
        top, mean = strips.max(1), strips.mean(1)
        # a chunk starts at every strip but the last of its document
        start = np.delete(np.arange(first[-1]), first[1:] - 1)
        pooled = np.concatenate([np.maximum(top[start], top[start + 1]), (mean[start] + mean[start + 1]) / 2], 1)
        d = pooled @ p["chunk"] + p["chunk_b"]
        np.maximum(d, 0, out=d)
        begin = first[:-1] - np.arange(len(first) - 1)
        best = np.maximum.reduceat(d, begin, axis=0)
        margin = best @ p["out"] + p["out_b"][0]
        return margin, ((z, a, strips, top, start, pooled, d, best, begin) if keep else None)

    def gradient(self, data: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean log loss."""
        p = self.p
        margin, (z, a, strips, top, start, pooled, d, best, begin) = self.forward(data, first, keep=True)
        g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)).astype(np.float32)
        grad = {"out": best.T @ g, "out_b": np.array([g.sum()], np.float32)}
        # a maximum passes its gradient to the first position that attains it
        gd = np.zeros_like(d)
        doc = np.repeat(np.arange(len(y)), np.diff(np.r_[begin, len(d)]))
        hit = (d == best[doc]) & (d > 0)
        order = np.cumsum(hit, axis=0)
        before = np.where(begin > 0, begin - 1, 0)
        base = np.where((begin > 0)[:, None], order[before], 0)
        firsts = hit & (order - base[doc] == 1)
        gd[firsts] = np.broadcast_to((g[:, None] * p["out"])[doc], d.shape)[firsts]
        grad["chunk"], grad["chunk_b"] = pooled.T @ gd, gd.sum(0)
        gp = gd @ p["chunk"].T
        gmax, gmean = gp[:, :FILTERS], gp[:, FILTERS:] / 2
        right = top[start + 1] > top[start]
        gtop = np.zeros_like(top)
        np.add.at(gtop, start, np.where(right, 0, gmax))
        np.add.at(gtop, start + 1, np.where(right, gmax, 0))
        gm = np.zeros_like(top)
        np.add.at(gm, start, gmean)
        np.add.at(gm, start + 1, gmean)
        ga = np.repeat((gm / (STRIP // STRIDE))[:, None], STRIP // STRIDE, axis=1)
        arg = strips.argmax(1)
        s, f = np.indices(arg.shape)
        ga[s, arg, f] += gtop
        ga = ga.reshape(-1, FILTERS)
        ga[a <= 0] = 0
        grad["conv_b"] = ga.sum(0)
        gy = np.zeros((len(z), TAPS * FILTERS), np.float32)
        for t in range(TAPS):
            gy[t:, t * FILTERS : (t + 1) * FILTERS] = ga[: len(z) - t]
        grad["conv"] = z.T @ gy
        gz = (gy @ p["conv"].T).reshape(-1, EMBED)
        grad["embed"] = np.stack([np.bincount(data, gz[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        return grad

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch_bytes: int = 40_000, rate: float = 0.004) -> ByteNet:
        """Adam over batches of about ``batch_bytes`` bytes."""
        rng = np.random.default_rng(3)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, None
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            cuts = np.cumsum([max(len(texts[k]), STRIP) for k in order]) // batch_bytes
            batches = [order[cuts == c] for c in np.unique(cuts)]
            total = total or epochs * len(batches)
            for pick in batches:
                off = np.r_[0, np.cumsum([len(texts[k]) for k in pick])]
                data, first = layout(np.frombuffer(b"".join(texts[k] for k in pick), np.uint8), off)
                grad = self.gradient(data, first, y[pick])
                step += 1
                now = rate * min(1.0, step / 30) * max(0.05, 1 - step / total)
                for k, v in grad.items():
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.01 * (v * v - m2[k])
                    self.p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities of whole texts; a long text is pooled run by run."""
        out = np.empty(len(off) - 1)
        for k in range(len(off) - 1):
            if off[k + 1] - off[k] > 2 * RUN_BYTES:
                out[k] = self._long(data[off[k] : off[k + 1]])
        small = np.flatnonzero(np.diff(off) <= 2 * RUN_BYTES)
        n = np.diff(off)[small]
        cuts = np.cumsum(n + STRIP) // RUN_BYTES
        for c in np.unique(cuts):
            pick = small[cuts == c]
            part = np.concatenate([data[off[k] : off[k + 1]] for k in pick])
            margin, _ = self.forward(*layout(part, np.r_[0, np.cumsum(np.diff(off)[pick])]))
            out[pick] = margin
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def _long(self, text: np.ndarray) -> float:
        """The margin of one long text: its chunks in runs that share a strip and a filter's span."""
        p, best = self.p, np.zeros(DETECTORS, np.float32)
        data, first = layout(text, np.array([0, len(text)]))
        for a in range(0, len(data) - STRIP, RUN_BYTES):
            b = min(len(data), a + RUN_BYTES + STRIP)
            run = np.r_[data[a : min(len(data), b + STRIDE * TAPS)], np.zeros(max(0, b + STRIDE * TAPS - len(data)), np.uint8)]
            z = p["embed"][run].reshape(-1, STRIDE * EMBED)
            y = z @ p["conv"]
            n = (b - a) // STRIDE
            act = np.maximum(p["conv_b"] + sum(y[t : t + n, t * FILTERS : (t + 1) * FILTERS] for t in range(TAPS)), 0)
            if b == len(data):
                act[1 - TAPS :] = 0
            strips = act.reshape(-1, STRIP // STRIDE, FILTERS)
            top, mean = strips.max(1), strips.mean(1)
            pooled = np.concatenate([np.maximum(top[:-1], top[1:]), (mean[:-1] + mean[1:]) / 2], 1)
            best = np.maximum(best, (pooled @ p["chunk"] + p["chunk_b"]).max(0))
        return float(np.maximum(best, 0) @ p["out"] + p["out_b"][0])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, epochs: int = EPOCHS) -> ByteNet:
    """Fits on at most ``rows`` whole labelled documents of at most ``most_bytes`` bytes each."""
    got = training_sample(docs, labels, "quality", rows, most_bytes).orderBy("doc_id").collect()
    y = np.array([r.y for r in got], float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    net = ByteNet(share=share)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        return net
    return net.fit([r.text.encode() for r in got], y, epochs)


def score_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``(doc_id, score)``, one row per document."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for i, j, off, data in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(shared.value.score(data, off))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
