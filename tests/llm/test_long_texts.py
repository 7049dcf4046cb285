"""Texts far longer than a run: pieces give what whole texts give, and memory follows the words, not 60 times the bytes."""

import random
import tracemalloc

import numpy as np
import pytest

from cohortvox.llm import decontaminate as D, neardup as N, toxicity as T
from cohortvox.llm.textcore import ALNUM, CHUNK_BYTES, NONSPACE, word_hashes, word_runs
from cohortvox.sources.workspace import Workspace
from test_decontaminate import brute as contaminated
from test_neardup import brute as components


def run(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def sample(n, seed=4):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["The", "Été", "x9", "b", "日本", "INSULT", "w" * 70, "ä1-b"]) + rnd.choice([" ", ", ", "\n", " "]) for _ in range(n))


@pytest.mark.parametrize("text", [sample(300), "", " ", "x" * 400, " " * 200 + "a" * 90, sample(40).rstrip()], ids=["mixed", "empty", "blank", "one word", "blanks first", "no end"])
@pytest.mark.parametrize("table", [ALNUM, NONSPACE])
def test_pieces_equal_the_whole(text, table):
    data, off = run(text)
    whole = word_hashes(data, off, table, 1 << 30)
    for most in (1, 7, 64):
        assert b"".join(bytes(p) for p, _ in word_runs(data, off, table, most)) == text.encode()
        for a, b in zip(whole, word_hashes(data, off, table, most), strict=True):
            assert a.tolist() == b.tolist()
    row, term = T.term_hashes(data, off, 64)
    assert not row.any() and set(term.tolist()) == set(T.term_hashes(data, off, 1 << 30)[1].tolist())


def test_a_run_of_several_texts_is_not_cut():
    data, off = np.frombuffer(b"ab cd ef", np.uint8), np.array([0, 5, 8])
    assert len(list(word_runs(data, off, ALNUM, 2))) == 1


@pytest.mark.parametrize("work, most", [  # most: times the bytes
    (lambda data, off: N.shingle_sets(data, off), 25),
    (lambda data, off: T.term_hashes(data, off), 3),
    (lambda data, off: D._segment([([1], np.array([len(h)]), h) for _, h in [word_hashes(data, off, ALNUM)]]), 25),
], ids=["shingles", "terms", "segment"])
def test_memory_of_twenty_megabytes(work, most):
    rnd = np.random.default_rng(1)
    words = [f"w{k:05d}" for k in range(20_000)]
    data, off = run(" ".join(words[k] for k in rnd.integers(0, len(words), 20_000_000 // 7)))
    work(data[: 2 * CHUNK_BYTES], np.array([0, 2 * CHUNK_BYTES]))  # tables of powers
    tracemalloc.start()
    work(data, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"peak {peak / len(data):.1f} x {len(data)} bytes")
    assert peak < most * len(data)


def test_operators_on_texts_of_many_runs(spark):
    rnd = random.Random(7)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3 * CHUNK_BYTES // 8)]
    near = words[:20_000] + ["other"] + words[20_001:]
    docs = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:900])), (4, "x" * (2 * CHUNK_BYTES)), (5, "x" * (2 * CHUNK_BYTES)), (6, None)]
    assert len(docs[0][1]) > 2 * CHUNK_BYTES
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = N.near_duplicates(d, Workspace(spark, "t")).collect()
    assert sorted(map(tuple, got)) == components(docs)
    at = next(k for k in range(len(words)) if len(" ".join(words[:k])) > CHUNK_BYTES)  # a window over the first cut
    items = [(1, " ".join(words[at - 7 : at + 8])), (2, "x" * (2 * CHUNK_BYTES)), (3, " ".join(words[50_000:50_010]))]
    got = D.contamination(d, spark.createDataFrame(items, "item_id long, text string"), Workspace(spark, "t")).drop("items").collect()
    assert sorted(map(tuple, got)) == sorted(contaminated(docs, items))
