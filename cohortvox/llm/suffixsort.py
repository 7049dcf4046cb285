"""Repeated byte windows by a depth-limited radix sort of suffixes.

A suffix is compared through its first ``threshold`` bytes only, so a group of
equal suffixes is a repeated window.  The bytes are taken in the order of three
digits, each dealt by its own Spark pass from the most significant on, and
groups of one suffix leave after each pass:

1. the *core*: the CORE_SHARE of the window that starts at its anchor, the
   core with the smallest hash in the window (the first of equal ones).  Equal
   windows have the same core at the same place.  Neighbouring windows share
   their anchor, so one row stands for all windows of an anchor, about one row
   for every 35 bytes instead of one a byte.
2. the *block*: all bytes of the windows that share an anchor.  Rows equal here
   agree in all their windows: all but the first row are repeats as they stand.
3. the *rest* of each window, only for the first rows of blocks whose core has
   other blocks too, which are the borders of repeats.  Where a core has at most
   TOGETHER blocks, their bytes meet in a task and are sorted there by digits of
   eight bytes; windows of a core with more are dealt by Spark once more.

Spark's digits are 64-bit hashes of two unlike families, so a group of pass 2 or
3 agrees in 128 bits.  Every pass is an aggregate that is combined before the
shuffle and a join whose large classes are broadcast (``join_classes``), so no
task gathers a passage that a large share of the documents holds.

Cases: null texts are empty; texts shorter than the threshold hold no window;
of equal texts the smallest id keeps its bytes; where ids are null or repeat,
rows are numbered by (id, hash of the text), null ids last; an empty table gives
no rows; other columns are ignored.  Texts are cut into runs of RUN bytes that
overlap, so a long text needs little memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.rownumbers import ids_name_rows, numbered
from cohortvox.llm.textcore import PrefixHash, bound_batches, mix, text_chunks
from cohortvox.operators.hotjoin import join_classes
from cohortvox.sources.workspace import Workspace

THRESHOLD = 100
CORE_SHARE = 0.32
#: Windows whose starts are handled at once.
RUN = 1 << 18
#: Blocks of a core up to which they are sorted in one task (at most twice the threshold in bytes each).
TOGETHER = 1_024
_PLACE = (1 << 20) - 1
#: Anchor place and the distances to its first and last window in one BIGINT.
_SHIFT = 16


class BlockHash:
    """A second family of span hashes: other byte values, another multiplier."""

    _MULT = np.uint64(0xD1342543DE82EF95)
    _INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    _BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
    _memo: list[np.ndarray] = []

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        with np.errstate(over="ignore"):
            if not self._memo or len(self._memo[0]) < n:
                size = max(n, RUN + 4096)
                self._memo[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, f, np.uint64)]) for f in (self._MULT, self._INV)]
            self._sum = np.zeros(n, np.uint64)
            np.cumsum(self._BYTE[data] * self._memo[0][: len(data)], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._sum[end] - self._sum[start]) * self._memo[1][start]


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (van Herk): two running minima over blocks."""
    n = len(x)
    full = -(-n // width) * width
    blocks = np.r_[x, np.full(full - n, x.max(), x.dtype)].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray, threshold: int, core: int):
    """``(row, anchor, first window, last window, core hash, block hash)``; places count from the start of ``data``."""
    if len(data) < threshold:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    at = np.arange(len(data) - core + 1)
    h = PrefixHash(data).spans(at, at + core)
    low = np.uint64(_PLACE)
    pick = (_least_of((h & ~low) | at.astype(np.uint64), threshold - core + 1) & low).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, off[:-1], 1)
    np.add.at(edge, np.maximum(off[:-1], off[1:] - threshold + 1), -1)
    start = np.flatnonzero(np.cumsum(edge[: len(pick)]) > 0)  # windows within one text
    if not len(start):
        return start, start, start, start, start.view(np.uint64), start.view(np.uint64)
    mine = pick[start]
    cut = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
    first, last, a = start[cut], start[np.r_[cut[1:], len(start)] - 1], mine[cut]
    with np.errstate(over="ignore"):
        block = mix(BlockHash(data).spans(first, last + threshold) + (a - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64))
    return np.searchsorted(off, a, "right") - 1, a, first, last, h[a], block


def _runs(col: pa.Array, threshold: int):
    """``(first row, offsets, bytes, place of the bytes in a text)``; a long text comes in overlapping runs."""
    for i, _, off, data in text_chunks(col, RUN):
        for a in range(0, max(len(data) - threshold + 1, 1), RUN) if len(off) == 2 else (0,):
            part = data[a : a + RUN + threshold - 1] if len(off) == 2 else data
            yield i, np.array([0, len(part)]) if len(off) == 2 else off, part, a


def _cores(threshold: int, core: int):
    def run(batches):
        for batch in batches:
            for _, off, data, _ in _runs(batch.column("text"), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, off, threshold, core)[4].view(np.int64))], ["core"])

    return run


def _rows(threshold: int, core: int):
    def run(batches):
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            for i, off, data, base in _runs(batch.column("text"), threshold):
                row, a, first, last, c, block = anchors(data, off, threshold, core)
                place = (a - off[row] + base) << 2 * _SHIFT | (a - first) << _SHIFT | (a - last)
                yield pa.RecordBatch.from_arrays([pa.array(doc[i + row]), pa.array(c.view(np.int64)), pa.array(block.view(np.int64)), pa.array(place)], ["doc", "core", "block", "place"])

    return run


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first window, last window)`` within the text."""
    a, mask = place >> 2 * _SHIFT, (1 << _SHIFT) - 1
    return a, a - (place >> _SHIFT & mask), a - (place & mask)


def _borders(threshold: int, core: int):
    """Bytes of the wanted anchors' windows; of cores with many blocks each window, with the hash of its bytes outside the core."""
    names = ["core", "rest", "doc", "place", "bytes"]

    def run(batches):
        for batch in batches:
            doc, wanted = batch.column("doc_id"), batch.column("wanted")
            for k in range(batch.num_rows):
                data = np.frombuffer((batch.column("text")[k].as_py() or "").encode(), np.uint8)
                place = wanted[k].values.field("place").to_numpy()
                cores, many = (wanted[k].values.field(c).to_numpy(zero_copy_only=False) for c in ("core", "many"))
                _, first, last = unpack(place)
                few = np.flatnonzero(~many)
                parts = [data[first[j] : last[j] + threshold].tobytes() for j in few]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cores[few]), pa.nulls(len(few), pa.int64()), pa.array([doc[k].as_py()] * len(few), pa.int64()), pa.array(place[few]), pa.array(parts, pa.binary())], names)
                order = np.flatnonzero(many)[np.argsort(first[many], kind="stable")]
                a, first, last = (v[order] for v in unpack(place))
                cores, j = cores[order], 0
                while j < len(a):  # anchors within a run of the text
                    low = first[j]
                    end = max(int(np.searchsorted(first, low + RUN)), j + 1)
                    part = data[low : int(last[j:end].max()) + threshold]
                    n = last[j:end] - first[j:end] + 1
                    begin = np.repeat(first[j:end] - low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    anchor = np.repeat(a[j:end] - low, n)
                    h = BlockHash(part)
                    with np.errstate(over="ignore"):
                        rest = mix(mix(h.spans(begin, anchor) + (anchor - begin).astype(np.uint64)) + h.spans(anchor + core, begin + threshold))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(cores[j:end], n)), pa.array(rest.view(np.int64)), pa.array([doc[k].as_py()] * int(n.sum()), pa.int64()),
                        pa.array(begin + low), pa.nulls(int(n.sum()), pa.binary()),
                    ], names)
                    j = end

    return run


def equal_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, threshold: int) -> np.ndarray:
    """A number for each window that another one of its group equals, -1 for the rest: radix passes from the first eight bytes on."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.full(len(start), -1, np.int64)
    left = np.arange(len(start))
    group = group.astype(np.int64)
    for at in range(0, threshold, 8):
        width = min(8, threshold - at)
        digit = padded[start[left, None] + np.arange(at, at + width)]
        value = np.zeros((len(left), 8), np.uint8)
        value[:, :width] = digit
        value = value.view(np.uint64).ravel()
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        head = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        number = np.cumsum(head) - 1
        several = np.bincount(number)[number] > 1
        left, group = left[order[several]], number[several]
        if not len(left):
            return out
    out[left] = group
    return out


def _sort_blocks(threshold: int):
    """Repeated windows among the blocks of each core; rows come sorted by core."""

    def marks(t: pa.Table) -> pa.RecordBatch:
        core, doc, place = (t.column(c).to_numpy() for c in ("core", "doc", "place"))
        parts = [x.as_py() for x in t.column("bytes")]
        a, first, last = unpack(place)
        n = last - first + 1
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = np.cumsum([0, *map(len, parts)])[:-1]
        at = first[row] + offset
        _, cores = np.unique(core, return_inverse=True)
        group = cores[row] * threshold + (a[row] - at)  # equal windows have their core at the same place
        same = equal_windows(np.frombuffer(b"".join(parts), np.uint8), base[row] + offset, group, threshold)
        order = np.lexsort((at, doc[row], same))
        again = np.r_[False, (same[order][1:] == same[order][:-1])] & (same[order] >= 0)
        flag = np.zeros(len(at), bool)
        flag[order[again]] = True
        edge = np.r_[True, (row[1:] != row[:-1])]  # runs of repeated windows of a block
        begin = np.flatnonzero(flag & (edge | ~np.r_[False, flag[:-1]]))
        end = np.flatnonzero(flag & (np.r_[edge[1:], True] | ~np.r_[flag[1:], False]))
        return pa.RecordBatch.from_arrays([pa.array(doc[row[begin]]), pa.array(at[begin]), pa.array(at[end])], ["doc", "first", "last"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            core = batch.column("core").to_numpy()
            if size >= 2_000 and held:  # all groups but the last are whole
                last = held[-1].column("core")[-1].as_py()
                cut = int(np.searchsorted(core != last, True)) if core[0] == last else 0
                if cut < len(core):
                    yield marks(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield marks(pa.Table.from_batches(held))

    return run


def repeated_windows(docs: DataFrame, ws: Workspace, threshold: int = THRESHOLD, together: int = TOGETHER) -> DataFrame:
    """``(doc, first, last)``: ranges of starts of windows that also start earlier; ``docs`` has unique ids."""
    core = max(8, int(threshold * CORE_SHARE))
    if not core < threshold < 1 << _SHIFT:
        raise ValueError("the threshold is out of range")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= threshold)
    # Pass 1: cores.
    cores = ws.table(src.mapInArrow(_cores(threshold, core), "core bigint").groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    n = cores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = src.mapInArrow(_rows(threshold, core), "doc bigint, core bigint, block bigint, place bigint")
    rows = ws.table(join_classes(rows, cores, ["core"], "n", n, "inner").drop("n"), "rows")
    ws.drop(cores)
    _let_go(ws)
    # Pass 2: blocks.
    blocks = rows.groupBy("core", "block").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("least"))
    blocks = ws.table(blocks.select("core", "block", "n", F.col("least.doc").alias("doc1"), F.col("least.place").alias("place1")), "blocks")
    again = join_classes(rows, blocks.where("n > 1"), ["core", "block"], "n", n, "inner").where("doc <> doc1 or place <> place1")
    anchor = F.shiftright("place", 2 * _SHIFT)
    mask = (1 << _SHIFT) - 1
    marks = ws.table(again.select("doc", (anchor - F.shiftright("place", _SHIFT).bitwiseAND(mask)).alias("first"), (anchor - F.col("place").bitwiseAND(mask)).alias("last")), "marks")
    ws.drop(rows)
    _let_go(ws)
    # Pass 3: the rest of the windows at the borders of repeats.
    shared = ws.table(blocks.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    n = shared.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    wanted = join_classes(blocks.drop("n"), shared, ["core"], "m", n, "inner")
    wanted = wanted.groupBy("doc1").agg(F.collect_list(F.struct("core", F.col("place1").alias("place"), (F.col("m") > together).alias("many"))).alias("wanted"))
    borders = src.join(wanted, F.col("doc_id") == F.col("doc1")).select("doc_id", "text", "wanted")
    borders = ws.table(borders.mapInArrow(_borders(threshold, core), "core bigint, rest bigint, doc bigint, place bigint, bytes binary"), "borders")
    ws.drop(blocks, shared)
    _let_go(ws)
    few = borders.where("rest is null").select("core", "doc", "place", "bytes").repartition("core").sortWithinPartitions("core")
    few = ws.table(few.mapInArrow(_sort_blocks(threshold), "doc bigint, first bigint, last bigint"), "few")
    windows = borders.where("rest is not null").select("core", "rest", "doc", F.col("place").alias("start"))
    first = windows.groupBy("core", "rest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("least")).where("n > 1")
    first = ws.table(first.select("core", "rest", "n", F.col("least.doc").alias("doc1"), F.col("least.start").alias("start1")), "first")
    n = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = join_classes(windows, first, ["core", "rest"], "n", n, "inner").where("doc <> doc1 or start <> start1")
    many = ws.table(later.select("doc", F.col("start").alias("first"), F.col("start").alias("last")), "many")
    ws.drop(borders, first)
    _let_go(ws)
    return marks.unionByName(few).unionByName(many)


def _let_go(ws: Workspace) -> None:
    """Spark deletes the shuffle files of finished steps when the driver collects garbage; this asks for it."""
    ws.spark.sparkContext._jvm.System.gc()


def _cut(threshold: int):
    """Per text its repeated spans and the bytes left."""

    def run(batches):
        for batch in batches:
            sizes, kept, flat, ends = [], [], [], [0]
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                data = (text.as_py() or "").encode()
                left, at, n = [], 0, 0
                if ranges.is_valid:
                    first, last = (ranges.values.field(c).to_numpy() for c in ("first", "last"))
                    order = np.argsort(first, kind="stable")
                    first, end = first[order], np.maximum.accumulate(last[order] + threshold)
                    cut = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
                    for a, b in zip(first[cut].tolist(), end[np.r_[cut[1:], len(end)] - 1].tolist()):
                        left.append(data[at:a])
                        flat.append((a, b))
                        at, n = b, n + 1
                sizes.append(len(data))
                kept.append(b"".join([*left, data[at:]]))
                ends.append(ends[-1] + n)
            spans = pa.StructArray.from_arrays([pa.array([f[k] for f in flat], pa.int64()) for k in (0, 1)], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, ws: Workspace, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: each text's repeated byte spans [start, end) and the bytes left without them."""
    bound_batches(docs.sparkSession)
    unique = ids_name_rows(docs)
    if not unique:
        docs = numbered(docs, ws).select("doc_id", "text", F.col("row.doc_id").cast("long").alias("known"))
    else:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("known"))
    marks = repeated_windows(docs, ws, threshold).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    both = docs.join(marks, "doc_id", "left").select(F.col("known").alias("doc_id"), "text", "ranges")
    return both.mapInArrow(_cut(threshold), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op12_radix_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op12"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The MD5 of every window's hexadecimal digits, the first of equal ones, islands of the others' bytes.
OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
n AS (SELECT doc_id, h, greatest(0, CAST(len(h) AS BIGINT) // 2 - 99) AS n FROM d),
w AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS s, unnest(list_transform(range(n), lambda s: md5_number(substr(h, 2 * s + 1, 200)))) AS w FROM n),
f AS (SELECT w, min({'d': doc_id, 's': s}) AS b FROM w GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS l FROM w JOIN f USING (w) WHERE doc_id <> b.d OR s <> b.s),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= l + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM r),
x AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM x),
g AS (SELECT doc_id, count(*) AS n, sum(b - a) AS m, max(b) AS e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS h FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(g.h, '') || substr(d.h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
