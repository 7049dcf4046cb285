import random
import zlib

import pytest

from cohortvox.llm import mixing as M, sharding as S
from cohortvox.llm.prefixsum import prefix_sums
from cohortvox.sources.workspace import Workspace


def docs(n=400, seed=1):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", "a b c " * rnd.randrange(30), "é\n" * rnd.randrange(9), "word " * 3])
    rows = [(k, text(), rnd.choice(["s1", "s1", "s1", "S2", "é", None, "t"]), 7) for k in range(n)]
    return rows + [(5, "dup", "s1", 7), (5, "dup", "s1", 7), (None, "no id", "t", 7)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)


def test_prefix_sums(spark):
    rows = [(k % 3, k // 2, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = prefix_sums(df, ["g", "k", "v"], ["v"], Workspace(spark, "t"), group=["g"]).collect()
    want, seen = [], {}
    for r in sorted(rows):
        b, n = seen.get(r[0], (0, 0))
        want.append((*r, b, n))
        seen[r[0]] = (b + r[2], n + 1)
    assert sorted(map(tuple, got)) == sorted(want)


def test_shards_match_brute_force(spark):
    rows = docs()
    got = S.balanced_shards(S.document_sizes(frame(spark, rows)), Workspace(spark, "t")).collect()
    size = [(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _, _ in rows]
    size.sort(key=lambda r: (r[0] is None, r))
    total, before, want, slots = sum(s for _, _, s in size), 0, [], {}
    for d, c, s in size:
        k = min(7, (2 * before + s) * 8 // (2 * total))
        slots[k] = slots.get(k, -1) + 1
        want.append((d, s, c, k, slots[k]))
        before += s
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=key) == sorted(want, key=key)
    staged = S.stage_shard(spark, frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, len((r.text or "").encode()) + 1, r.shard) for r in staged), key=key) == sorted(((r[0], r[1], r[3]) for r in want), key=key)
    assert S.stage_shard(spark, frame(spark, rows).limit(0), "").count() == 0
    assert S.balanced_shards(S.document_sizes(frame(spark, rows).limit(0)), Workspace(spark, "t")).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = docs(seed=seed)
    ws = Workspace(spark, "t")
    got = M.mix(M.document_words(frame(spark, rows)), ws).collect()
    again = M.mix(M.document_words(frame(spark, rows).repartition(5)), ws).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = {}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    staged = M.stage_mix(spark, frame(spark, rows), "").collect()
    copies = {}
    for r in staged:
        copies[r.doc_id, r.source, r.text] = copies.get((r.doc_id, r.source, r.text), 0) + 1
    for r, t in {(r.doc_id, r.source): (r.size, r.taken) for r in got}.items():
        if r[0] not in (5, None) and t[0]:
            assert sum(n for k, n in copies.items() if k[:2] == r) == -(-t[1] // t[0])
    assert M.mix(M.document_words(frame(spark, rows).limit(0)), ws).count() == 0


def test_word_count(spark):
    for t, n in [("", 0), (None, 0), (" a\tb\x0bc d  ", 4), ("x", 1), ("\x1fq", 1)]:
        assert spark.createDataFrame([(t,)], "t string").select(M.word_count(M.F.col("t")).alias("n")).first().n == n
