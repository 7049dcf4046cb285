

import corpus_pipeline as P
from cohortvox.llm import toxicity
from cohortvox.sources.workspace import Workspace

from test_decontaminate import brute as contaminated
from test_neardup import brute as components
from test_prefix import targets


def tables(spark, tmp_path, extra=True):
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(4)]
    docs = []
    for k in range(240):
        w = [word() for _ in range(rnd.choice([8, 40, 90]))]
        if k % 4 == 0:
            w[3:3] = ["insult"] * 2
        if k % 10 == 3:
            w += items[k % 4][1].split()
        docs.append((k, " ".join(w), "en", rnd.choice(["a", "b", None]), len(w)))
    docs += [(300 + k, docs[k][1] + " tail", "en", "b", 1) for k in range(0, 240, 7)]
    docs += [(600, None, "en", "a", 0), (601, "", None, None, 0), (602, "one", "en", "c", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(d[0], 1, int(d[0] % 4 == 0)) for d in docs[:240]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, items


def test_stages_follow_their_rules(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    sf, cols = str(tmp_path), ["doc_id", "text", "lang", "source", "n_chars"]
    ws = Workspace(spark, "t")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before = [tuple(r) for r in now.collect()]
        now = ws.table(stage(spark, now, sf), name)
        after = now.collect()
        seen[name] = len(after)
        if name != "shard":
            assert now.columns == cols
        rows = sorted(str(tuple(r[c] for c in cols)) for r in after)
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            score = {r.doc_id: r.score for r in toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
            assert rows == sorted(str(r) for r in before if score[r[0]] < 0.5)
        elif name == "near_dedup":
            kept = {r[0] for r in components([b[:2] for b in before], 5) if r[3]}
            assert rows == sorted(str(r) for r in before if r[0] in kept)
        elif name == "decontaminate":
            bad = {r[0] for r in contaminated([b[:2] for b in before], items) if r[5]}
            assert bad and rows == sorted(str(r) for r in before if r[0] not in bad)
        elif name == "mix":
            sizes = {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
            for s, want in targets(sizes).items():
                got = sum(len((r.text or "").split()) for r in after if r.source == s)
                assert want - 1 <= got <= want + max(len((r[1] or "").split()) for r in before if r[3] == s)
        else:
            assert rows == sorted(str(r) for r in before) and now.columns == [*cols, "shard"]
            size = [sum(len((r.text or "").encode()) + 1 for r in after if r.shard == k) for k in range(8)]
            # copies of a document share a shard, so a cut is off by less than the two copies of one document
            assert max(size) - min(size) <= 4 * max(len((r.text or "").encode()) + 1 for r in after)
    final = P.run(spark, sf)
    assert final.count() == seen["shard"]


def test_empty_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "doc_id as size", "1 as shard", "array(source) as rep", "'x' as taken", "2 as key")
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() and (name == "shard" or out.columns == docs.columns)
