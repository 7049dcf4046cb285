import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cohortvox.llm import suffixsort as S
from cohortvox.sources.workspace import Workspace


def brute(texts, threshold=100):
    """``[(bytes, spans, kept)]`` of texts in the order of their ids."""
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - threshold + 1):
            w = hashlib.blake2b(data[s : s + threshold], digest_size=16).digest()
            if w in seen:
                gone[s : s + threshold] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        out.append((len(data), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def corpus(rnd):
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(60), prose(400)
    texts = [None, "", "x", "a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, "a" * 250 + "b" * 250, prose(500), shared, long]
    texts += [prose(20) + " " + shared + " " + prose(20) for _ in range(30)]  # one core with many blocks
    texts += [long] * 20 + [long[:700] + "X" + long[701:], long[3:], prose(5) + long[50:600] + long[200:900]]
    texts += [shared[:40] + prose(3) + shared[40:150], prose(30) * 4, "".join(rnd.choice("ab") for _ in range(3000))]
    return texts


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect())


def test_all_windows_by_brute_force(spark):
    texts = corpus(random.Random(1))
    rows = [(k * 3 - 9, t, "c", 7) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, core string, start int").repartition(5)
    want = [(r[0], *b) for r, b in zip(rows, brute(texts))]
    assert rows_of(S.remove_repeats(df, Workspace(spark, "t"))) == want
    short = [(r[0], *b) for r, b in zip(rows, brute(texts, 40))]
    assert rows_of(S.remove_repeats(df, Workspace(spark, "t"), 40)) == short


def test_query_and_hot_classes(spark, tmp_path, monkeypatch):
    from cohortvox.operators import hotjoin

    monkeypatch.setattr(hotjoin, "HOT_ROWS", 8)
    monkeypatch.setattr(hotjoin, "HOT_CLASSES", 100)
    monkeypatch.setattr(S.repeated_windows, "__defaults__", (100, 5))  # some cores have more blocks, some fewer
    texts = corpus(random.Random(2))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in S.op12_radix_suffix_dedup(spark, str(tmp_path)).collect())
    want = [(k, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, (n, spans, kept) in enumerate(brute(texts))]
    assert got == want


def test_radix_passes_of_a_task():
    rnd = np.random.default_rng(5)
    data = rnd.integers(0, 2, 4000).astype(np.uint8)
    start, group = rnd.integers(0, 3980, 3000), rnd.integers(0, 4, 3000)
    got = S.equal_windows(data, start, group, 19)
    keys = [(g, data[s : s + 19].tobytes()) for s, g in zip(start, group)]
    for i in range(0, 3000, 7):
        assert (got[i] >= 0) == (keys.count(keys[i]) > 1)
    assert len({(k, g) for k, g in zip(keys, got) if g >= 0}) == len({g for g in got if g >= 0}) == len({k for k in keys if keys.count(k) > 1})


def test_null_and_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "z" + text)], "doc_id long, text string")
    got = S.remove_repeats(df, Workspace(spark, "t")).collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, len(r.kept)) for r in got)
    assert kept == [(False, 1, 0), (False, 1, len(text)), (False, 2, 1), (True, 0, 0), (True, 0, 0)]
    assert S.remove_repeats(df.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("run", [50, 1000])
def test_runs_of_long_texts_hold_every_window_once(monkeypatch, run):
    monkeypatch.setattr(S, "RUN", run)
    rnd = random.Random(3)
    text = "".join(rnd.choice("abc ") for _ in range(5000))
    col = pa.array(["short", text, None, text[:150], "y" * 300])
    found = {}
    for i, off, data, base in S._runs(col, 100):
        row, a, first, last, _, _ = S.anchors(data, off, 100, 32)
        for r, x, f, e in zip(row, a, first, last):
            for s in range(f, e + 1):
                key = (i + r, int(s - off[r] + base))
                assert key not in found and s <= x <= s + 68
                found[key] = int(x - off[r] + base)
    lengths = [5, 5000, 0, 150, 300]
    assert sorted(found) == [(k, s) for k, n in enumerate(lengths) for s in range(n - 99)]
    assert all(found[3, s] == found[1, s] for s in range(51))  # equal windows have equal anchors


def test_a_long_text_across_runs(spark):
    rnd = random.Random(4)
    part = "".join(rnd.choice("abcdef ") for _ in range(150_000))
    texts = [part + "1" + part + "2" + part[:70_000], part[1000:90_000] + "!" + part]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(S.remove_repeats(df, Workspace(spark, "t"))) == [(k, *b) for k, b in enumerate(brute(texts))]
