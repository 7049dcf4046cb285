"""Text queries over whole tables against brute force."""
from cohortvox.plans import report as P, text_queries as Q


def test_concepts_of_every_turn(spark, tmp_path):
    slots = ["enhancement_sentence", "necrosis_sentence", "edema_sentence", "ventricles_sentence"]
    said = ["plain words", "a long beginning, then necrosis", "Edema here and Necrosis there", "surrounding edema", None]
    turns = [(c, t, said[(c * 7 + t * t) % 5]) for c in range(6) for t in range(11)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    place = {name: k for k, name in enumerate(P.SLOTS)}
    text = {(c, t // 4, slots[t % 4]): x for c, t, x in turns}
    bad = {k: any(w.lower() in (x or "").lower() for w in [*P.BANNED, *(P.SLOTS[k[2]][3] or ())]) for k, x in text.items()}
    want = []
    for c, b, slot in text:
        n = 0
        for concept, owner in P.OWNERS.items():
            words = (concept, concept.replace("_", " "))
            has = lambda k: text.get(k) is not None and not bad[k] and any(w in text[k].lower() for w in words)  # noqa: B023, E731
            n += slot != owner and has((c, b, slot)) and has((c, b, owner)) and place[owner] < place[slot]
        want.append((c, b, slot, n))
    got = sorted(map(tuple, Q.r16(spark, str(tmp_path)).collect()))
    assert got == sorted(want) and any(r[3] for r in got)


def test_every_line_is_checked(spark, tmp_path):
    slots = [k for k, v in P.SLOTS.items() if v]
    texts = ["Fine start.\nA malignant\tline.\n" + "x" * 600, "Certainly.\nfine", "", None, "One.\n\nlow start,"]
    docs = [(k, texts[k % 5]) for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(d, n, None if x is None else x.replace("\t", " ")) for d, t in docs for n, x in enumerate([None] if t is None else t.split("\n"))]
    got = {(r.case_id, r.line, r.slot): r for r in Q.r17(spark, str(tmp_path)).collect()}
    assert len(got) == len(lines)
    for d, n, x in lines:
        r = got[d // len(slots), n, slots[d % len(slots)]]
        assert r.original == x
        assert ("banned" in r.violations) == any(w in (x or "").lower() for w in ("malignant", "certainly"))
    fallback = P.SLOTS["ventricles_sentence"][2]
    short = lambda x: x and (fallback if x in ("A malignant line.", "Certainly.") else x[:147] + "..." if len(x) > 150 else x)
    none_last = lambda r: (r[0], r[1])
    assert sorted(map(tuple, Q.r15(spark, str(tmp_path)).collect()), key=none_last) == [(d, n, short(x)) for d, n, x in lines]
    signs = {(r.doc_id, r.line): r.signs for r in Q.r21(spark, str(tmp_path)).collect()}
    assert len(signs) == len(lines) and signs[4, 2] == 3 and signs[4, 0] == 0


def test_eight_orders_stay_a_case(spark, tmp_path):
    keys = [k for base in (0, 800_000, 1_600_000, 80_000_000_000) for k in range(base + 8, base + 24)]
    rows = [(k, f"{k % 8 % 4 + 1}-X", "O") for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    cases = {f"C{k // 800_000 or ''}-{k // 8 % 100_000:05d}-000" for k in keys}
    assert len(cases) == 8
    assert {r.dir for r in Q.a07(spark, str(tmp_path)).collect()} == {f"/cohort/{c}" for c in cases}
    assert {(r.case_id, r.complete, r.files) for r in Q.a08(spark, str(tmp_path)).collect()} == {(c, True, 4) for c in cases}
    assert {r.case_id for r in Q.a10(spark, str(tmp_path)).collect()} == cases
    assert [r.action for r in Q.a06(spark, str(tmp_path)).collect()] == ["rename"] * 32
