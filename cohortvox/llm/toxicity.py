"""Toxicity by a factorization machine over hashed terms.

A document's features are the hashed words and word beginnings it holds
(presence, so length and repetition change nothing).  Labelled documents are
hashed on the executors; every term of at least MIN_DOCS of them, whatever its
label, gets a weight and a factor vector, so that a pair of terms (an insult
with a mention of a group) has a weight of its own through the product of its
factors.  Pairs of frequent terms whose joint presence departs from the labels
expected without it start with factors of their own, also where each term alone
says nothing; regularisation decides on the rest.  Scoring is one pass without a shuffle.

Cases: null and empty texts have no features and get the bias; without labels
of both classes the score is the labels' share (0 without any); repeated rows
are scored each; other columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.labelled import TRAIN_ROWS, held_out, training_sample
from cohortvox.llm.textcore import ALNUM, CHUNK_BYTES, LOWER, PrefixHash, bound_batches, text_chunks, word_runs, word_spans

#: Bytes of a word's beginning that are a feature beside the word.
BEGINNINGS = (4, 6)
#: Labelled documents that a term needs at least.
MIN_DOCS = 4
FACTORS = 4
#: Terms fitted first at most, and the chi-square that they need; no term is left out by them.
FIRST = 4_096
FIRST_CHI2 = 15.0
#: Terms whose pairs are tested: of so many labelled documents at least, the most frequent of them.
PAIR_DOCS = 20
PAIR_TERMS = 4_096
#: First factor of a term in a pair that tells the classes apart, and the spread of all others'.
PAIR_START = 0.5
START = 0.02
#: Passes over the sample of the first fit, and of that of all terms.
EPOCHS = 60
ALL_EPOCHS = 60
#: Gradients below this move a parameter in proportion, so rare terms stay small.
DAMP = 1e-3
THRESHOLD = 0.5


def _run_terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = word_spans(data, off, ALNUM)
    h = PrefixHash(LOWER[data])
    rows, terms = [row], [h.spans(start, end)]
    for k in BEGINNINGS:
        long = end - start > k
        rows.append(row[long])
        terms.append(h.spans(start[long], start[long] + k) ^ np.uint64(k))
    return np.concatenate(rows), np.concatenate(terms)


def term_hashes(data: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every word and beginning of a run of texts, with repeats; of a long text each term once a piece."""
    if len(off) != 2 or len(data) <= most:
        return _run_terms(data, off)
    terms = np.concatenate([np.unique(_run_terms(*piece)[1]) for piece in word_runs(data, off, ALNUM, most)])
    return np.zeros(len(terms), np.int64), terms


def _features(batches):
    for batch in batches:
        y = batch.column("y").to_numpy()
        for i, j, off, data in text_chunks(batch.column("text")):
            row, term = term_hashes(data, off)
            lists = [np.unique(term[row == k]) for k in range(j - i)]
            ends = np.cumsum([len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([
                pa.array(y[i:j]),
                pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(lists).view(np.int64))),
            ], ["y", "terms"])


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, share: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """``(term, term, sign)`` of pairs whose joint presence departs from what a model expects (``share``), strongest first: of each term the strongest.

    The sum of residuals over the documents that hold both is compared with its
    standard error; the bar is the largest of as many normal deviates as there
    are pairs.  Neither term needs to say anything alone.
    """
    d = np.bincount(np.concatenate(rows), minlength=n)
    some = np.flatnonzero(d >= PAIR_DOCS)
    some = np.sort(some[np.argsort(-d[some], kind="stable")][:PAIR_TERMS])
    if len(some) < 2:
        return []
    place = np.full(n, -1)
    place[some] = np.arange(len(some))
    x = np.zeros((len(some), len(y)), bool)
    for k, r in enumerate(rows):
        at = place[r]
        x[at[at >= 0], k] = True
    residual, spread = (y - share).astype(np.float32), (share * (1 - share)).astype(np.float32)
    bar = np.sqrt(4 * np.log(len(some)))
    best, partner, sign = np.zeros(len(some)), np.full(len(some), -1), np.zeros(len(some), int)  # of each term its strongest pair
    for a in range(0, len(some), 256):
        part = x[a : a + 256].astype(np.float32)
        for b in range(a - a % 1024, len(some), 1024):
            rest = x[b : b + 1024].astype(np.float32).T
            z = (part * residual) @ rest / np.sqrt((part * spread) @ rest + 1e-6)
            z[(part @ rest < PAIR_DOCS) | (np.abs(z) <= bar) | (a + np.arange(len(part))[:, None] >= b + np.arange(rest.shape[1])[None])] = 0
            for axis, base, other in ((1, a, b), (0, b, a)):
                top = np.abs(z).argmax(axis)
                value = np.take_along_axis(z, np.expand_dims(top, axis), axis).squeeze(axis)
                at = base + np.flatnonzero(np.abs(value) > best[base : base + len(value)])
                best[at], partner[at], sign[at] = np.abs(value[at - base]), other + top[at - base], np.sign(value[at - base])
    pairs = {(min(i, j), max(i, j)): (best[i], sign[i]) for i, j in enumerate(partner.tolist()) if j >= 0}
    return [(int(some[i]), int(some[j]), int(s)) for (i, j), (_, s) in sorted(pairs.items(), key=lambda p: (-p[1][0], p[0]))]


def costs(terms: int, factors: int) -> tuple[float, float]:
    """What a weight and a factor vector cost, in standard errors: the largest that chance gives to so many terms."""
    bar = np.sqrt(2 * np.log(max(terms, 2)))
    return bar, bar + np.sqrt(factors)


def _train(p: dict, rows: list[np.ndarray], y: np.ndarray, rng, cost: np.ndarray | None = None, damp: float = 1e-8,
           epochs: int = EPOCHS, rate: float = 0.03, decay: float = 1e-3) -> None:
    """Updates bias, weights and factors; with ``cost``, a term's parameters shrink to zero by it and steps end small."""
    n, factors = p["v"].shape
    weight_cost, factor_cost = costs(n, factors)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    size = int(np.clip(len(y) // 8, 32, 512))
    t, last = 0, epochs * -(-len(y) // size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), size):
            pick = order[a : a + size]
            at = np.concatenate([rows[k] for k in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[k]) for k in pick])
            per_doc = lambda x: np.bincount(doc, x[at], len(pick))  # noqa: B023, E731
            per_term = lambda x: np.bincount(at, x[doc], n)  # noqa: B023, E731
            v = p["v"]
            s = np.stack([per_doc(v[:, f]) for f in range(factors)], 1)
            z = p["b"][0] + per_doc(p["w"]) + 0.5 * ((s * s).sum(1) - per_doc((v * v).sum(1)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            xg = per_term(g)
            xs = np.stack([per_term(g * s[:, f]) for f in range(factors)], 1)
            grad = {"b": np.array([g.sum()]), "w": xg + decay * p["w"] * 0.1, "v": xs - xg[:, None] * v + decay * v}
            t += 1
            now = rate if cost is None else rate * min(1, 2 * (1 - t / (last + 1)))
            for k in p:
                m1[k] += 0.1 * (grad[k] - m1[k])
                m2[k] += 0.001 * (grad[k] ** 2 - m2[k])
                root = np.sqrt(m2[k] / (1 - 0.999**t)) + damp
                p[k] -= now * (m1[k] / (1 - 0.9**t)) / root
                if cost is not None and k == "w":
                    p[k] = np.sign(p[k]) * np.maximum(0, np.abs(p[k]) - now * weight_cost * cost / root)
                elif cost is not None and k == "v":
                    norm = np.maximum(np.sqrt((p[k] ** 2).sum(1)), 1e-12)
                    p[k] *= np.maximum(0, 1 - now * factor_cost * cost / root.mean(1) / norm)[:, None]


class FactorizationMachine:
    """bias + sum of weights + half of (square of summed factors - summed squares)."""

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.terms, self.bias, self.weight, self.factor = terms, bias, weight, factor
        bits = 1 << 20
        self.filter = np.zeros(bits, bool)
        self.filter[terms & np.uint64(bits - 1)] = True

    @staticmethod
    def margin(x: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ factor
        return bias + x @ weight + 0.5 * ((s * s).sum(1) - x @ (factor * factor).sum(1)), s

    @classmethod
    def fit(cls, terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS):
        """``rows``: per document the indices of its terms.  Adam on the log loss.

        Terms that tell the classes apart alone are fitted first, as a start, and
        pairs of terms that do so beyond them are sought.  Then all terms learn;
        those neither told apart alone nor in a pair pay for a weight or factors
        in standard errors of their gradient, and those left at zero are dropped.
        """
        rng = np.random.default_rng(11)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 1e-3
        p = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(len(terms)), "v": rng.normal(0, START, (len(terms), factors))}
        if not len(terms) or y.min() == y.max():
            return cls(terms[:0], float(p["b"][0]), p["w"][:0], p["v"][:0])
        n, n1 = len(y), y.sum()
        d = np.bincount(np.concatenate(rows), minlength=len(terms)).astype(float)
        d1 = np.bincount(np.concatenate(rows), np.repeat(y, [len(r) for r in rows]), len(terms))
        with np.errstate(invalid="ignore", divide="ignore"):
            chi2 = np.nan_to_num(n * (d1 * (n - n1 - d + d1) - (d - d1) * (n1 - d1)) ** 2 / (d * (n - d) * n1 * (n - n1)))
        best = np.flatnonzero(chi2 >= FIRST_CHI2)
        best = np.sort(best[np.argsort(-chi2[best], kind="stable")][:FIRST])
        place = np.full(len(terms), -1)
        place[best] = np.arange(len(best))
        first = {"b": p["b"], "w": p["w"][best], "v": rng.normal(0, 0.05, (len(best), factors))}
        if len(best):
            _train(first, [place[r][place[r] >= 0] for r in rows], y, rng)
        p["b"], p["w"][best], p["v"][best] = first["b"], first["w"], first["v"]
        cost = np.sqrt(d / n * (1 - d / n) * share * (1 - share) / n)
        cost[best] = 0
        expected = np.array([first["b"][0] + first["w"][q].sum() + 0.5 * ((first["v"][q].sum(0) ** 2).sum() - (first["v"][q] ** 2).sum()) for q in (place[r][place[r] >= 0] for r in rows)])
        used = np.zeros(factors, int)
        started = np.zeros((len(terms), factors), bool)
        for i, j, sign in telling_pairs(rows, y, 1 / (1 + np.exp(-np.clip(expected, -30, 30))), len(terms)):
            if not (started[i] & started[j]).any() and not (started[i].any() and started[j].any()):
                f = int(np.argmin(used + len(terms) * (started[i] | started[j])))
                for k, s in ((i, 1), (j, sign)):
                    p["v"][k, f] = s * PAIR_START
                    started[k, f] = True
                used[f] += 1
            cost[i] = cost[j] = 0
        _train(p, rows, y, rng, cost, DAMP, ALL_EPOCHS)
        keep = (p["w"] != 0) | p["v"].any(1)
        return cls(terms[keep], float(p["b"][0]), p["w"][keep], p["v"][keep])

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities of a run of texts; memory follows the terms found, not the vocabulary."""
        n = len(off) - 1
        z = np.full(n, self.bias)
        if len(self.terms) and len(data):
            row, term = term_hashes(data, off)
            some = self.filter[term & np.uint64(len(self.filter) - 1)]
            row, term = row[some], term[some]
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            hit = self.terms[at] == term
            pair = np.unique(row[hit].astype(np.int64) * len(self.terms) + at[hit])
            row, at = pair // len(self.terms), pair % len(self.terms)
            z += np.bincount(row, self.weight[at] - 0.5 * (self.factor[at] ** 2).sum(1), n)
            for k in range(self.factor.shape[1]):
                z += 0.5 * np.bincount(row, self.factor[at, k], n) ** 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fits on at most ``rows`` labelled documents; the driver gets the term numbers of each."""
    bound_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "toxic", rows).select("y", "text")
    hashed = sample.mapInArrow(_features, "y int, terms array<bigint>").persist()
    n, n1 = hashed.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = hashed.select(F.explode("terms").alias("term")).groupBy("term").count().where(F.col("count") >= MIN_DOCS)
    both = 0 < n1 < n
    chosen = np.sort(counts.select("term").toArrow().column("term").to_numpy().view(np.uint64)) if both else np.zeros(0, np.uint64)
    if len(chosen):
        shared = docs.sparkSession.sparkContext.broadcast(chosen)

        def select(batches):
            for batch in batches:
                lists = []
                for t in batch.column("terms").to_pylist():
                    t = np.array(t, np.int64).view(np.uint64)
                    at = np.minimum(np.searchsorted(shared.value, t), len(shared.value) - 1)
                    lists.append(at[shared.value[at] == t].tolist())
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lists, pa.list_(pa.int32()))], ["y", "at"])

        got = hashed.mapInArrow(select, "y int, at array<int>").toArrow()
        data = [x.values.to_numpy() for x in got.column("at")]
        y = got.column("y").to_numpy().astype(float)
        order = sorted(range(len(y)), key=lambda k: (y[k], data[k].tobytes()))  # an order that reruns share
        data, y = [data[k].astype(np.int64) for k in order], y[order]
    else:
        data, y = [np.zeros(0, np.int64)] * n, np.r_[np.ones(n1), np.zeros(n - n1)]
    hashed.unpersist()
    return FactorizationMachine.fit(chosen, data, y)


def score_documents(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``(doc_id, score)``, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j, off, data in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(shared.value.score(data, off))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def op8_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the machine rejects; texts are read once and stay in place."""
    shared = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            score = np.concatenate([shared.value.score(data, off) for _, _, off, data in text_chunks(batch.column(at))] or [np.zeros(0)])
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
