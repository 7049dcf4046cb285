import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cohortvox.llm import tokenmerge as M


@pytest.fixture(scope="module")
def pair():
    return M.tokenizer_pair(None)


TEXTS = [
    None, "", " ", "Hello world", "  two  spaces\n\nlines\t", "don't we'll 123 4567", "naïve café über straße", "日本語 テキスト", "emoji 👩‍👩‍👧 ok", "a▁b",
    "<|endoftext|> and <s> </s> <unk>", "\x00\x01 control", "x" * 3000, "ﬁ ligature é ́", "Ünïcödé " * 40, " leading", "trailing ", "͸ unassigned", "\r\n win \r\n",
    "нет да", "ש לום", "�", "  sep", "é " * 20, "Hello world",
]


def naive(pair, text):
    """Groups of ids by walking the two ends, both encoded whole by the libraries."""
    if not text:
        return [], [], []
    a = pair.a_model.encode(" " + text, add_special_tokens=False).ids
    b = pair.b_model.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.a.tokens[k] for k in a) != whole or b"".join(pair.b.tokens[k] for k in b) != whole:
        return [], [], []
    ends = lambda v, ids: [int(e) for e in np.cumsum([len(v.tokens[k]) for k in ids])]
    ea, eb = ends(pair.a, a), ends(pair.b, b)
    groups, ga, gb, j = [], [], [], 0
    for k, e in zip(a, ea):
        ga.append(k)
        while j < len(b) and eb[j] <= e:
            gb.append(b[j])
            j += 1
            if eb[j - 1] == e:
                groups.append((ga, gb))
                ga, gb = [], []
    return a, b, groups


def test_merge_path_finds_common_ends():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n = int(rnd.integers(1, 120))
        a, b = (np.flatnonzero(rnd.random(n) < rnd.random()) for _ in range(2))
        for piece in (1, 2, 3, 7, 1000):
            x, y = M.links(a, b, piece)
            assert a[x].tolist() == b[y].tolist() == sorted(set(a) & set(b))
            i, j = M.diagonals(a, b, piece)
            assert (np.diff(i) + np.diff(j) <= piece).all() and (i[-1], j[-1]) == (len(a), len(b))


def test_encoders_agree_with_the_libraries(pair, monkeypatch):
    assert pair.cuts and pair.fast is not None
    monkeypatch.setattr(M, "RUN_CHARS", 7)
    rnd = random.Random(2)
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice("ab e's\n\t 12É,.!ß日") for _ in range(rnd.randrange(200))) for _ in range(300)]
    texts += ["one two three four five six seven " * 20]
    for t in texts:
        a, b, _ = naive(pair, t)
        got = pair.encode(t)
        assert got[0].tolist() == a and got[1].tolist() == b, t


def test_bound_of_pairs(pair):
    assert 32_000 < M.pair_bound(pair) < 2_000_000


def expected(pair, texts):
    parts = [naive(pair, t) for t in texts]
    count = Counter((ga[-1], gb[-1]) for _, _, groups in parts for ga, gb in groups)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    for a, b, groups in parts:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        yield (
            len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if a else "",
        )


def test_query_by_brute_force(spark, tmp_path, pair):
    rnd = random.Random(4)
    texts = TEXTS * 2 + ["word " * 60_000 + "end", "".join(rnd.choice("abc \n") for _ in range(150_000)), "z" * 100_000]
    rows = [(k if k != 5 else None, t, "x", [1]) for k, t in enumerate(texts)] + [(3, "Hello world", "x", [1])]
    spark.createDataFrame(rows, "doc_id long, text string, pairs string, a array<int>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op13_merge_path_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *w) for r, w in zip(rows, expected(pair, [r[1] for r in rows]))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_digest_in_steps_and_small_pieces(spark, monkeypatch, pair):
    monkeypatch.setattr(M, "DIGEST_TOKENS", 5)
    text = "The quick brown fox, naïve as ever; jumps over 12345 lazy dogs."
    a, b = pair.encode(text)
    x, y = M.links(np.cumsum(pair.a.length[a]), np.cumsum(pair.b.length[b]), 3)
    assert M.group_digest((M.Digits(len(pair.a.tokens)), M.Digits(len(pair.b.tokens))), a, b, x, y) == next(expected(pair, [text]))[-1]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = M.aligned(df, piece=2).first()
    assert (r.a, r.b, r.a_last, r.b_last) == (a.tolist(), b.tolist(), x.tolist(), y.tolist())
    paths = tuple(map(public_tokenizers.path, (M.A_NAME, M.B_NAME))) + (None,)
    assert M.aligned(df.limit(0), paths).count() == 0 and M.summaries(M.aligned(df, paths), paths).first().n_groups == len(x)
