"""SQL twins of the registered queries that SQL can express (DuckDB)."""

from __future__ import annotations

#: All pairs by cosine, then the smallest vector reachable.
OP1 = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
c(id, lab) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION (SELECT p.b, min(f.lab) FROM c f JOIN p ON p.a = f.id JOIN recurring.c o ON o.id = p.b WHERE f.lab < o.lab GROUP BY p.b))
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, c.lab AS component_id, c.lab = v.vec_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) l ON l.a = v.vec_id
"""

#: Windows of 13 words as strings, met with the runs of as many words of each document.
OP4 = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS t FROM b, LATERAL (SELECT unnest(range(1, greatest(2, CAST(len(w) AS BIGINT) - 11))) AS i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM win) z, LATERAL (SELECT unnest(range(1, CAST(len(w) AS BIGINT) - z.n + 2)) AS i)),
h AS (SELECT doc_id, item_id, i, g.n FROM g JOIN win USING (n, t)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Shared shingles of one document per distinct set, then the smallest document reachable.
OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS sh FROM w, LATERAL (SELECT unnest(range(1, greatest(2, CAST(len(w) AS BIGINT) - 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, bit_xor(hash(sh)) AS f FROM s GROUP BY 1),
k AS (SELECT *, min(doc_id) OVER (PARTITION BY n, f) AS rep FROM n),
r AS (SELECT s.doc_id, s.sh, k.n FROM s JOIN k USING (doc_id) WHERE k.doc_id = k.rep),
df AS (SELECT sh, count(*) AS c FROM r GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM r a JOIN df USING (sh) JOIN r b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 80 * (na + nb - i)),
c(id, lab) USING KEY (id) AS (SELECT DISTINCT rep, rep FROM k UNION (SELECT e.b, min(f.lab) FROM c f JOIN e ON e.a = f.id JOIN recurring.c o ON o.id = e.b WHERE f.lab < o.lab GROUP BY e.b))
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, coalesce(c.lab, d.doc_id) AS component_id, coalesce(c.lab, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.id = k.rep
"""

#: CRC-32 by its byte table (reflected polynomial 0xEDB88320), prefix sums of bytes, equal cuts by the middle byte.
OP5 = r"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, size, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS BIGINT) AS crc FROM b, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, crc, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INT) AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, crc, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""


#: The primes of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = 1 << 64


def _times(x: str, p: int) -> str:
    return f"(({x}) * {p}::UHUGEINT % {_M}::UHUGEINT)"


def _turned(x: str, bits: int) -> str:
    return f"(({x}) * {1 << bits}::UHUGEINT % {_M}::UHUGEINT + (({x}) >> {64 - bits}))"


def _xxhash(steps: list[tuple[str, int]], source: str) -> str:
    """CTEs h0 to h<n> that hash non-negative columns (of 4 or 8 bytes) one after another, from seed 42."""
    ctes, seed, at = [f"h0 AS (SELECT *, 42::UHUGEINT AS h FROM {source})"], "h", 0

    def add(expr: str) -> None:
        nonlocal at
        at += 1
        ctes.append(f"h{at} AS (SELECT * REPLACE (({expr})::UHUGEINT AS h) FROM h{at - 1})")

    for col, width in steps:
        value = f"({col})::UHUGEINT"
        if width == 8:
            add(f"xor(({seed} + {_P5 + 8}::UHUGEINT) % {_M}::UHUGEINT, {_times(_turned(_times(value, _P2), 31), _P1)})")
            add(f"({_times(_turned('h', 27), _P1)} + {_P4}::UHUGEINT) % {_M}::UHUGEINT")
        else:
            add(f"xor(({seed} + {_P5 + 4}::UHUGEINT) % {_M}::UHUGEINT, {_times(value, _P1)})")
            add(f"({_times(_turned('h', 23), _P2)} + {_P3}::UHUGEINT) % {_M}::UHUGEINT")
        add(_times("xor(h, h >> 33)", _P2))
        add(_times("xor(h, h >> 29)", _P3))
        add("xor(h, h >> 32)")
    return ",\n".join(ctes) + f",\nhashed AS (SELECT * FROM h{at})"


#: Targets in closed form, then each source in hash order (as signed numbers), cut at its budget.
OP10 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
{_xxhash([("1234567", 4), ("doc_id", 8), ("size", 8)], "d")},
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (budget - capped) / rest AS level FROM o),
f AS (SELECT arg_min(level, (cap / weight, capped)) FILTER (WHERE level * weight <= cap) AS level FROM l),
g AS (SELECT source, source_size, coalesce(least(cap, f.level * weight), cap) AS target FROM l, f),
q AS (SELECT h.doc_id, h.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END AS epochs,
 sum(h.size) OVER (PARTITION BY h.source ORDER BY CASE WHEN h.h >= 9223372036854775808::UHUGEINT THEN 0 ELSE 1 END, h.h, h.doc_id, h.size ROWS UNBOUNDED PRECEDING) - h.size AS before FROM hashed h JOIN g ON h.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM q
"""
