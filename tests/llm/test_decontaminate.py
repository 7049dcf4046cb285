import hashlib
import random
import re

import pytest

from cohortvox.llm import decontaminate as D
from cohortvox.sources.workspace import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=13):
    wins = [(i, tuple(w[k : k + size])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - size + 1))]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fixture():
    rnd = random.Random(5)
    vocab = ["the", "Été", "x9", "b", "CC", "ä", "zz", "q"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 3, 13, 14, 30]))) for i in range(14)] + [(99, None), (100, ""), (101, "..."), (None, text(15))]
    docs = [(i, text(rnd.choice([0, 1, 5, 40, 200])) + (items[rnd.randrange(14)][1] or "").upper() + text(rnd.choice([0, 30])) + items[3][1]) for i in range(60)]
    docs += [(70, items[-1][1]), (71, items[-1][1] + items[5][1]), (60, None), (61, ""), (62, "!!!"), (63, items[5][1]), (63, items[5][1]), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("words_per_segment", [50, 10**6])
def test_contamination_matches_brute_force(spark, monkeypatch, words_per_segment):
    docs, items = fixture()
    monkeypatch.setattr(D.build_index, "__defaults__", ("doc_id", "text", words_per_segment))
    d = spark.createDataFrame([(a, b, "e") for a, b in docs], "doc_id long, text string, item_id string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(d, i, Workspace(spark, "t"), slice_terms=200).drop("items").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items), key=key)


@pytest.mark.parametrize("words_per_segment", [50, 10**6])
def test_more_slices_than_a_pass_holds(spark, monkeypatch, words_per_segment):
    docs, items = fixture()
    monkeypatch.setattr(D.build_index, "__defaults__", ("doc_id", "text", words_per_segment))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([*items, items[5], (77, items[5][1])], "item_id long, text string")
    ws = Workspace(spark, "t")
    assert len(D.query_slices(i, ws, slice_terms=30)) > D.QUERY_SLICES
    got = D.contamination(d, i, ws, slice_terms=30)
    assert dict(got.dtypes) == dict(D.contamination(d, i, ws).dtypes)
    key = lambda r: tuple((x is None, x) for x in r)
    want = brute(docs, [*items, (77, items[5][1])])
    assert sorted(map(tuple, got.drop("items").collect()), key=key) == sorted(want, key=key)


def test_proximity_stays_in_a_document(spark):
    d = spark.createDataFrame([(1, "a x b"), (2, "a b"), (3, "a"), (4, "b"), (5, "a x x x b")], "doc_id long, text string").coalesce(1)
    index = D.build_index(d, Workspace(spark, "t"))
    import numpy as np

    from cohortvox.llm.textcore import hash_bytes

    phrase = hash_bytes([b"a", b"b"])
    near = D.search(index, np.array([7]), [phrase], slack=1).collect()
    assert sorted(r.doc_id for r in near) == [1, 2]
    assert [r.doc_id for r in D.search(index, np.array([7]), [phrase]).collect()] == [2]


def test_varints_round_trip():
    import numpy as np

    g = np.array([0, 1, 127, 128, 16383, 16384, 2**33, 5])
    assert (D.decode_gaps(D.encode_gaps(g)) == g).all()
    assert len(D.decode_gaps(D.encode_gaps(g[:0]))) == 0


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, i, Workspace(spark, "t")).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in D.contamination(one, i, Workspace(spark, "t")).collect()] == [0]


def test_stage_judges_each_row(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, item), (None, "r1 r2 r3 r4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item, 1), (1, "clean words", 2), (None, item, 3), (None, "more clean words", 4), (2, None, 5), (3, "x r1 r2 r3 r4", 6), (3, "x r1 r2 r3", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    assert sorted(r.row for r in D.stage_decontaminate(spark, df, str(tmp_path)).collect()) == [2, 4, 5, 7]
    one = df.where("row in (1, 4, 5, 6)").withColumn("doc_id", df["row"])
    assert sorted(r.row for r in D.stage_decontaminate(spark, one, str(tmp_path)).collect()) == [4, 5]


def test_a_text_beyond_one_chunk(spark):
    from cohortvox.llm.textcore import CHUNK_BYTES

    item = " ".join(f"q{k}" for k in range(20))
    long = " ".join(f"w{k}" for k in range(CHUNK_BYTES // 5))
    docs = [(1, long + " " + item), (2, item + " " + long), (3, long)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"), Workspace(spark, "t"))
    assert sorted((r.doc_id, r.n_hit, r.items) for r in got.collect()) == [(1, 20, [5]), (2, 20, [5]), (3, 0, [])]
