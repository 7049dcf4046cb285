import random

import pytest

from cohortvox.llm import tokencount as T

P = pytest.importorskip("public_tokenizers")


def reference(texts):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return [len(m.encode(t)) if t else 0 for t in texts]


def texts():
    rnd = random.Random(9)
    atoms = ["the", "Thing", "é", "日本", "\n", " ", "  ", "\t", "▁", "▁▁", "<s>", "</s>", "<0x0A>", "a", "b\nc", " ", "\r\n", "x" * 40, "1234", "🎉", "́", "!!", "$$$", "\x00", "​", "ing", " the"]
    out = ["", None, " ", "\n", "\n\n", "  \n  ", "a", " a", "a ", "▁", "\n▁a", "word " * 3000, "q" * 5000]
    return out + ["".join(rnd.choice(atoms) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]


def test_counts_equal_the_library():
    c = T.PieceCounter(P.path("piece_bpe_32k.model"), memory=50)
    t = texts()
    assert c.splits and c.newline and len(c.whole) > 20_000
    assert [c.count(x) for x in t] == reference(t)


def test_query_columns(spark):
    t = texts()[:400]
    df = spark.createDataFrame([(k, x, "z") for k, x in enumerate(t)] + [(None, "a b", "z"), (1, "a b", "z")], "doc_id long, text string, n_tokens string")
    got = T.token_counts(df.repartition(3), limit=100).collect()
    want = [(k, len((x or "").encode()), n, n > 100) for k, (x, n) in enumerate(zip(t, reference(t), strict=True))] + [(None, 3, 2, False), (1, 3, 2, False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert T.token_counts(df.limit(0)).count() == 0
