import hashlib
import itertools
import random
import re
import zlib

from cohortvox.llm import dialogue as D
from cohortvox.sources.workspace import Workspace


def brute(codes):
    """The least (cost, audit) over all edits with at most one insertion of two turns in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    options = []
    for initial, fault in codes:
        o = [("D", 3, "")]
        if fault not in "bd":
            extra = fault == "t"
            o += [("K", 0 + extra, initial), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
        options.append(o)
    for rows in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(codes) + 1):
            initials = ins[0] + "".join(r[2] + g for r, g in zip(rows, ins[1:]))
            if re.fullmatch("(s?(ua)+)?", initials):
                audit = "I" * len(ins[0]) + "".join(r[0] + "I" * len(g) for r, g in zip(rows, ins[1:]))
                got = (sum(r[1] for r in rows) + 2 * sum(map(len, ins)), audit)
                best = min(best, got) if best else got
    return best


def test_agenda_against_all_edits():
    rnd = random.Random(1)
    for _ in range(60):
        codes = [rnd.choice("suax") + rnd.choice("---tbd") for _ in range(rnd.randrange(4))]
        ((state, found),) = D.lightest(codes, goals=D.ACCEPTED).items()
        assert state in D.ACCEPTED and found == brute(codes), codes


def test_blocks_join_to_the_same_derivation():
    rnd = random.Random(2)
    for _ in range(200):
        codes = [rnd.choice("suuaaax") + rnd.choice("-----ttbd") for _ in range(rnd.randrange(1, 60))]
        size = rnd.randrange(1, 9)
        chains = {"-": (0, "", None)}
        for k in range(0, len(codes), size):
            chains = D.follow(chains, {s: D.lightest(codes[k : k + size], s) for s in D.FOLLOWS})
        ends = [(chains[s][0], D.audit_of(chains[s])) for s in D.ACCEPTED if s in chains]
        assert min(ends) == next(iter(D.lightest(codes, goals=D.ACCEPTED).values()))


def expected(rows):
    """The query's row of one conversation, by its text."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    after = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            after += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    digest = lambda r, x, c: hashlib.md5(f"{'none' if c is None else c}:{len(r)}:{r}{x}".encode()).hexdigest()
    after.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], digest(v[1], v[2], rows[0][0])))
    seen, codes = set(), []
    for _, r, x in after:
        body = x.rstrip(D.WHITE)
        fault = "b" if not body else "d" if (r, x) in seen else "-" if body[-1] in ".!?" else "t"
        seen.add((r, x))
        codes.append((r[:1] if r[:1] in ("s", "u", "a") else "x") + fault)
    if not after:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    ((_, (cost, audit)),) = D.lightest(codes, goals=D.ACCEPTED).items()
    out, left = [], list(after)
    for e in audit:
        row = left.pop(0) if e != "I" else None
        if e == "D":
            continue
        role = row[1] if e == "K" else "assistant" if out and out[-1].startswith("user:") else "user"
        if e == "K":
            role = row[1]
        out.append(f"{role}:{row[2] if row else ''}")
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in D.LEGAL for a, b in zip(after, after[1:]))
    return (gaps, *[sum(c[1] == f for c in codes) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_query_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D.repair, "__defaults__", (16,))
    rnd = random.Random(5)
    texts = ["Hello there.", "Why?", "yes", "", "  \t", "no end", "Done!  \n", None, "x" * 300_000 + ".", "Grüße. "]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 5, 9]), rnd.choice(roles), rnd.choice(texts)) for c in [*range(30), None] for _ in range(rnd.randrange(1, 9))]
    rows += [(777, k, ("user", "assistant")[k % 2], f"turn {k % 50}.") for k in range(300)]  # a third of all rows, over many blocks
    one = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(one, 0, "user", "gone")]  # nothing is left of it
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, pos long, key string").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = D.op11_lightest_repair(spark, str(tmp_path)).collect()
    want = {c: expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_turns_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "")], schema)
    totals, turns = D.repair(df, Workspace(spark, "t"))
    assert [tuple(r)[1:] for r in turns.collect()] == [(0, "K", "system", "S."), (1, "I", "user", ""), (2, "K", "assistant", "A.")]
    assert totals.first().asDict() == {"conv_id": 1, "gaps": 0, "blank": 1, "duplicate": 0, "truncated": 0, "illegal": 1, "cost": 5, "audit": "KIKD"}
    totals, turns = D.repair(df.limit(0), Workspace(spark, "t"))
    assert totals.count() == 0 and D.digests(turns).count() == 0
