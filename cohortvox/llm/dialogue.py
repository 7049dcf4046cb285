"""Conversation structure repair as a lightest derivation (Knuth 1977).

A conversation is legal when its role initials read ``(s?(ua)+)?``.  Edits keep,
rerole, delete or insert rows.  Items are ``At(i, state)``: the first i rows are
repaired and the output is in ``state``.  Deductions are hyperedges with two
premises, such an item and a row's edit, or with one (an insertion); each adds a
cost and a letter to the audit.  These functions are monotone and superior in
the order of (cost, audit): the result is never less than a premise, and two
audits of one item with equal cost are never beginnings of each other (all but
the letters I stand for rows, and an I costs), so a lesser premise gives a lesser
result.  An agenda pops items by (cost, audit); each is final when popped.

On Spark a conversation is cut into blocks of BLOCK rows by global positions
(range partitions and prefix sums).  A block is solved from every state it can
be entered in, all blocks independently; the derivations of its blocks are then
joined in order, with four audits in memory.  So rows of a hot conversation
are spread over the tasks, except for the last pass, which writes its turns in
order.

Cases: null roles and texts are one space; null conversation ids are one
conversation; turns that tie are taken by role, then by a digest of the text,
so equal rows are adjacent; a conversation without rows has cost 0 and an empty
audit; an empty table gives no rows; other columns are ignored; a text of any
length moves with its row only.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.prefixsum import prefix_sums
from cohortvox.llm.textcore import bound_batches
from cohortvox.operators.hotjoin import join_classes
from cohortvox.sources.workspace import Workspace

#: Rows of a block; its audits take BLOCK bytes for each of its items.
BLOCK = 512
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: State of the output ("-" before the first turn, else the last initial) -> what may follow.
FOLLOWS = {"-": "su", "s": "u", "u": "a", "a": "u"}
ACCEPTED = "-a"
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
#: Solved blocks that a worker remembers; most short conversations have one of a few shapes.
MEMORY = 4_096


def edits(code: str, state: str) -> list[tuple[str, int, str]]:
    """``(letter, cost, next state)`` of a row; ``code`` is its initial and its fault (b, d, t or -)."""
    initial, fault = code
    out = [("D", DELETE, state)]
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        if initial in FOLLOWS[state]:
            out.append(("K", extra, initial))
        out += [("R", REROLE + extra, r) for r in ROLES if r in FOLLOWS[state]]
    return out


def lightest(codes: list[str], start: str = "-", goals: str | None = None) -> dict[str, tuple[int, str]]:
    """``state -> (cost, audit)`` of the items after the last row; with ``goals``, of the first of them that is final."""
    agenda, final, n = [(0, "", 0, start)], set(), len(codes)
    ends: dict[str, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            ends[state] = (cost, audit)
            if goals and state in goals:
                return {state: (cost, audit)}
        for r in ROLES:
            if r in FOLLOWS[state] and (i, r) not in final:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, r))
        if i < n:
            for letter, more, to in edits(codes[i], state):
                if (i + 1, to) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letter, i + 1, to))
    return ends


def _less(a: tuple, b: tuple) -> bool:
    """Whether chain ``a`` is before ``b``, both (cost, part, parent): by cost, then by audit from where they part."""
    if a[0] != b[0]:
        return a[0] < b[0]
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[2], b[2]
    return "".join(reversed(left)) < "".join(reversed(right))


def follow(before: dict[str, tuple], block: dict[str, dict[str, tuple[int, str]]]) -> dict[str, tuple]:
    """Chains after a block from the chains before it."""
    after: dict[str, tuple] = {}
    for state, chain in before.items():
        for to, (cost, audit) in block.get(state, {}).items():
            new = (chain[0] + cost, audit, chain)
            if to not in after or _less(new, after[to]):
                after[to] = new
    return after


def audit_of(chain: tuple) -> str:
    parts = []
    while chain[2] is not None:
        parts.append(chain[1])
        chain = chain[2]
    return "".join(reversed(parts))


def _solver(size: int):
    """One row per block: its ways from state to state and its counts."""

    def run(batches):
        memory: dict[tuple[bool, str], tuple] = {}
        for batch in batches:
            rows = []
            for conv, block, codes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "codes")), strict=True):
                found = memory.get((block == 0, codes))
                if found is None:
                    c = [codes[k : k + 2] for k in range(0, len(codes), 2)]
                    if block == 0 and len(c) < size:  # the whole conversation
                        ways = [("-", to, *w) for to, w in lightest(c, goals=ACCEPTED).items()]
                    else:
                        ways = [(s, to, *w) for s in ("-" if block == 0 else FOLLOWS) for to, w in lightest(c, s).items()]
                    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(c, c[1:]))
                    found = (ways, illegal, *[sum(x[1] == f for x in c) for f in "bdt"], c[0][0], c[-1][0])
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[block == 0, codes] = found
                ways, illegal, blank, duplicate, truncated, first, last = found
                rows.append({
                    "conv_id": conv, "block": block, "ways": [dict(zip(("entry", "exit", "cost", "audit"), w)) for w in ways],
                    "illegal": illegal, "blank": blank, "duplicate": duplicate, "truncated": truncated, "first": first, "last": last,
                })
            yield pa.RecordBatch.from_pylist(rows, _BLOCKS)

    return run


_BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()),
    ("ways", pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
    *[(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated")], ("first", pa.string()), ("last", pa.string()),
])
_BLOCKS_DDL = (
    "conv_id bigint, block bigint, ways array<struct<entry:string,exit:string,cost:bigint,audit:string>>, "
    "illegal bigint, blank bigint, duplicate bigint, truncated bigint, first string, last string"
)
_TOTALS = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _join(batches):
    """Joins the blocks of each conversation; blocks come in order."""
    conv, chains, sums, last = None, None, None, None

    def closed():
        end = None
        for state in ACCEPTED:
            if state in chains and (end is None or _less(chains[state], end)):
                end = chains[state]
        return (conv, *sums, end[0], audit_of(end))

    names = [f.split()[0] for f in _TOTALS.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if chains is None or r["conv_id"] != conv:
                if chains is not None:
                    out.append(closed())
                conv, chains, sums, last = r["conv_id"], {"-": (0, "", None)}, [0] * 4, None
            ways: dict[str, dict] = {}
            for w in r["ways"]:
                ways.setdefault(w["entry"], {})[w["exit"]] = (w["cost"], w["audit"])
            chains = follow(chains, ways)
            for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
                sums[k] += r[c]
            sums[3] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*out))], names)
    if chains is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, closed())], names)


_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches):
    """Turns after repair, from rows in order behind their conversation's audit (position -1)."""
    conv, audit, at, place, state = None, "", 0, 0, "-"

    def put(edit, role, text):
        nonlocal place, state
        if edit != "K":
            role = ROLES[next(r for r in FOLLOWS[state] if r in ROLES)]
        state = role[0]
        place += 1
        return conv, place - 1, edit, role, text

    for batch in batches:
        out = []
        for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "pos", "role", "text")), strict=True):
            if pos < 0:
                while at < len(audit):  # insertions behind the last row
                    out.append(put("I", None, ""))
                    at += 1
                conv, audit, at, place, state = c, text, 0, 0, "-"
                continue
            while audit[at] == "I":
                out.append(put("I", None, ""))
                at += 1
            if audit[at] != "D":
                out.append(put(audit[at], role, text))
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TURNS.types)] if out else [pa.array([], t) for t in _TURNS.types], schema=_TURNS)
    out = [put("I", None, "") for _ in audit[at:]]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TURNS.types)], schema=_TURNS)


def placed_rows(conversations: DataFrame, ws: Workspace) -> DataFrame:
    """``(conv_id, pos, turn, role, text, key, sound)``: rows numbered within their conversation, as a written table.

    ``key`` is a digest of conversation, role and text; ``sound`` is b for a
    blank text, t for one that does not end with a mark, else -.
    """
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(
        conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    known = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    end = F.rtrim("text", F.lit(WHITE))
    rows = rows.select(
        "*", F.col("turn").isNotNull().alias("has_turn"), F.md5(F.concat_ws(":", known, F.length("role").cast("string"), F.concat("role", "text"))).alias("key"),
        F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "-").otherwise("t").alias("sound"),
    )
    placed = prefix_sums(rows, ["conv_id", "has_turn", "turn", "role", "key"], [], ws, ["conv_id"])
    return ws.table(placed.select("conv_id", F.col("rows_before").alias("pos"), "turn", "role", "text", "key", "sound"), "placed")


def faults(placed: DataFrame, ws: Workspace) -> DataFrame:
    """``(conv_id, pos, code)``: initial and first fault of each row."""
    again = placed.groupBy("key").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1")
    again = ws.table(again, "again")
    rows = join_classes(placed.select("conv_id", "pos", "key", "sound", F.substring("role", 1, 1).alias("i")), again, ["key"], "n", placed.count())
    fault = F.when(F.col("sound") == "b", "b").when(F.col("pos") > F.col("first_pos"), "d").otherwise(F.col("sound"))
    return rows.select("conv_id", "pos", F.concat(F.when(F.col("i").isin("s", "u", "a"), F.col("i")).otherwise("x"), fault).alias("code"))


def repair(conversations: DataFrame, ws: Workspace, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Cheapest repairs of all conversations with rows: ``(conversations, turns)``.

    The first holds (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit); the second the repaired turns (conv_id, place, edit, role, text),
    each conversation's in order within one partition.
    """
    bound_batches(conversations.sparkSession)
    placed = placed_rows(conversations, ws)
    block = F.expr(f"pos div {size}")
    cells = faults(placed, ws).groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    cells = cells.select("conv_id", "block", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"))
    solved = ws.table(cells.mapInArrow(_solver(size), _BLOCKS_DDL), "blocks")
    totals = solved.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_join, _TOTALS)
    span = placed.groupBy(F.col("conv_id").alias("__c")).agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    totals = totals.join(span, F.col("conv_id").eqNullSafe(F.col("__c"))).select(
        "conv_id", F.coalesce(F.expr("hi - lo + 1 - n"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    totals = ws.table(totals, "totals")
    ahead = totals.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    rows = ahead.unionByName(placed.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return totals, rows.mapInArrow(_apply, "conv_id bigint, place bigint, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of turns as ``repair`` gives them; a conversation is hashed as it streams by."""

    def run(batches):
        conv, state = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    name = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"), kind.alias("kind"),
    ).where("kind <> 0").drop("copy", "kind")


def op11_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op11")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    totals, turns = repair(damaged(conversations), ws)
    shas = digests(turns).withColumnRenamed("conv_id", "__s")
    every = conversations.select(F.col("conv_id").cast("long").alias("__i")).distinct()
    out = every.join(totals, F.col("__i").eqNullSafe(F.col("conv_id")), "left").join(shas, F.col("__i").eqNullSafe(F.col("__s")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("__i").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: CRC-32 by its byte table, then the cheapest edits row by row with up to two insertions before each and at the end.
OP11_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(regexp_extract_all(hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM conversations),
h AS (SELECT o.*, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS BIGINT) % 20 AS h FROM o, t),
dm AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS c FROM h WHERE h <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i FROM dm),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM r),
ins AS (SELECT * FROM (VALUES ('-', '-', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('-', 'u', 2, 'I', ['user:']), ('s', 'u', 2, 'I', ['user:']), ('a', 'u', 2, 'I', ['user:']), ('u', 'a', 2, 'I', ['assistant:']), ('-', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'a', 4, 'II', ['user:', 'assistant:'])) x(q, z, c, a, o)),
ok AS (SELECT * FROM (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) x(q, z)),
ed AS (SELECT conv_id, i, 'D' AS e, q, q AS z, 3 AS c, [] AS o FROM f, (VALUES ('-'), ('s'), ('u'), ('a')) x(q)
 UNION ALL SELECT conv_id, i, 'K', q, z, CASE fault WHEN 't' THEN 1 ELSE 0 END, [role || ':' || text] FROM f JOIN ok ON z = ini WHERE fault IN ('t', '-')
 UNION ALL SELECT conv_id, i, 'R', q, z, CASE fault WHEN 't' THEN 3 ELSE 2 END, [CASE z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM f, ok WHERE z <> 's' AND fault IN ('t', '-')),
st AS MATERIALIZED (SELECT ins.q, e.conv_id, e.i, e.z, ins.c + e.c AS c, ins.a || e.e AS a, ins.o || e.o AS o FROM ins JOIN ed e ON e.q = ins.z),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '-' AS q, {'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])} AS b FROM (SELECT DISTINCT conv_id FROM f)
 UNION ALL SELECT st.conv_id, st.i, st.z, min({'c': CAST(p.b.c + st.c AS BIGINT), 'a': p.b.a || st.a, 'o': p.b.o || CAST(st.o AS VARCHAR[])}) FROM p JOIN st ON st.conv_id IS NOT DISTINCT FROM p.conv_id AND st.i = p.i + 1 AND st.q = p.q GROUP BY 1, 2, 3),
n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY 1),
il AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS l, ini FROM f) WHERE l IS NOT NULL AND l || ini NOT IN ('su', 'ua', 'au') GROUP BY 1),
g AS (SELECT p.conv_id, min({'c': CAST(p.b.c + ins.c AS BIGINT), 'a': p.b.a || ins.a, 'o': p.b.o || CAST(ins.o AS VARCHAR[])}) AS b FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN ins ON ins.q = p.q WHERE ins.z IN ('-', 'a') GROUP BY 1)
SELECT d.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(il.illegal, 0) AS illegal,
 coalesce(g.b.c, 0) AS cost, coalesce(g.b.a, '') AS audit, sha256(coalesce(array_to_string(g.b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN il ON il.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id
"""
