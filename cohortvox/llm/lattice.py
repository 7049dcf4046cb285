"""Embedding near-duplicates by lattice hashing.

Each of several tables projects the unit vectors onto random orthonormal
directions, scales them and decodes each group of eight coordinates to the
nearest point of the E8 lattice.  A vector enters the cells nearest to it (its
own and probed neighbours); the tables' directions are orthogonal to each other
as far as the vectors' length allows.  Cells get finer as rows grow (``TIERS``),
so that unrelated vectors do not meet more often in a larger table.

1. Only cell entries (cell, vector key, 64 sign bits) are shuffled.  A cell that
   holds few near pairs by their sign bits gives those pairs; a large or dense
   cell is handed on as such.
2. A pair is compared in the smallest cell that found it.  Vectors are shipped to
   the tasks that compare them only: once for each such cell, and once for each
   block pair of a large cell.  Cosines are computed in double precision.
3. A pair that shares large cells counts in the smallest of them only, which a
   task sees from the large cells of both, so links of dense groups are counted
   without being listed: a task returns the number of links of each vector and a
   spanning set of links.

Vectors of every length are compared, each with those of its own length.  Equal
vectors form a class with a weight first.  Null and zero vectors, vectors with
null or non-finite components and rows with a null vec_id link with nothing
(a null vec_id has a null component and is not kept).  Rows that share a vec_id
are separate vectors with one node.  Extra columns are ignored; empty tables give
nothing.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.operators.hotjoin import join_classes
from cohortvox.llm.textcore import groups, mix
from cohortvox.operators.graph import components
from cohortvox.sources.workspace import Workspace

COSINE = 0.9


class Setting(NamedTuple):
    """Lattice points of a cell, lattice units per unit of length (at length 64), cells entered a table, tables, neighbours of a point looked at."""

    points: int
    scale: float
    probes: int
    tables: int
    near: int


#: Up to so many vectors, the lattice.  Pairs at cosine 0.90 exactly meet with a chance of 0.95 or more in each of
#: them, pairs at 0.95 of 0.99 or more (tests/llm/test_lattice.py).
TIERS = (
    (500_000, Setting(2, 4.5, 8, 5, 8)),
    (12_000_000, Setting(3, 4.0, 16, 6, 8)),
    (100_000_000, Setting(4, 3.5, 24, 6, 8)),
    (math.inf, Setting(4, 4.0, 32, 8, 10)),
)
#: Entries of a cell whose pairs are looked at in one piece, and pairs an entry above which a cell counts as dense.
SMALL = 512
DENSE = 16
#: Standard deviations by which the differing sign bits of a linked pair may pass their mean.
SIGMAS = 4
#: Vectors of one block of a large cell.
BLOCK = 1024
#: Tasks (about 200 bytes each with their partners) up to which they are broadcast to the vectors.
BROADCAST_ROWS = 250_000


def setting_for(rows: int) -> Setting:
    return next(s for most, s in TIERS if rows <= most)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(1)
    k = np.arange(len(odd))
    r[odd, worst] += np.where(gap[k, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8 or D8 shifted by one half, whichever is closer."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(out)


class Lattice:
    """The random projections of all tables for vectors of one length."""

    def __init__(self, dim: int, setting: Setting = TIERS[0][1], seed: int = 8):
        rng = np.random.default_rng([seed, dim])
        self.setting, self.dim = setting, dim
        width = 8 * setting.points
        self.maps: list[np.ndarray] = []
        tables = setting.tables * (1 if dim >= width else 2)  # short vectors have no orthogonal directions to use
        while len(self.maps) < tables:
            each = min(max(1, dim // width), tables - len(self.maps))
            if dim >= width:
                q = np.linalg.qr(rng.normal(size=(dim, each * width)))[0]
            else:
                q = rng.normal(size=(dim, width)) / np.sqrt(dim)
            self.maps += [q[:, k * width : (k + 1) * width] * setting.scale * np.sqrt(dim / 64) for k in range(each)]
        self.shifts = [rng.uniform(0, 1, width) for _ in self.maps]
        self.weights = [rng.integers(1, 1 << 62, width, dtype=np.uint64) | np.uint64(1) for _ in self.maps]
        self.signs = rng.normal(size=(dim, 64))
        self.roots = roots()

    def signature(self, unit: np.ndarray) -> np.ndarray:
        """64 sign bits of random projections as one integer."""
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)[:, 0]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Per vector the 64-bit keys of its cells, table by table, nearest first."""
        out = []
        _, _, probes, _, near = self.setting
        for t, (m, s, w) in enumerate(zip(self.maps, self.shifts, self.weights, strict=True)):
            u = unit @ m + s
            dist = key = None
            for p in range(self.setting.points):
                x = u[:, 8 * p : 8 * p + 8]
                home = nearest_e8(x)
                gap = x - home
                far = 2.0 - 2.0 * gap @ self.roots.T  # growth of the squared distance at each neighbour
                pick = np.argpartition(far, near, axis=1)[:, :near]
                more = np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(far, pick, 1)], 1)
                spots = np.concatenate([home[:, None], home[:, None] + self.roots[pick]], 1)
                with np.errstate(over="ignore"):
                    k = (np.rint(2 * spots).astype(np.int64).view(np.uint64) * w[8 * p : 8 * p + 8]).sum(2, dtype=np.uint64)
                    if dist is None:
                        dist, key = more, k
                    else:
                        dist = (dist[:, :, None] + more[:, None]).reshape(len(x), -1)
                        key = (key[:, :, None] + k[:, None]).reshape(len(x), -1)
                best = np.argsort(dist, axis=1, kind="stable")[:, :probes]
                dist, key = np.take_along_axis(dist, best, 1), np.take_along_axis(key, best, 1)
            out.append(mix(key ^ mix(np.full(1, (self.dim << 16) + t + 1, np.uint64))))
        return np.concatenate(out, 1)


@functools.lru_cache(maxsize=32)
def lattice(dim: int, setting: Setting) -> Lattice:
    return Lattice(dim, setting)


def by_length(col: pa.Array):
    """``(rows, matrix)`` of an Arrow list column's valid vectors, one length at a time."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[off[rows][:, None] + np.arange(d)].astype(np.float64) + 0.0  # no negative zeros
        ok = np.isfinite(x).all(1) & x.any(1)
        yield rows[ok], x[ok]


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=0, keepdims=True)  # against overflow and underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _digests(col: pa.Array) -> pa.Array:
    """A digest of each valid vector; equal vectors have equal digests."""
    out: list[bytes | None] = [None] * len(col)
    for rows, x in by_length(col):
        for k, v in zip(rows.tolist(), x, strict=True):
            out[k] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
    return pa.array(out, pa.binary())


def _fingerprint(*keep: str):
    def run(batches):
        for batch in batches:
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, _digests(batch.column("embedding"))], [*keep, "digest"])

    return run


def _cells(setting: Setting):
    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            for rows, x in by_length(batch.column("embedding")):
                lat = lattice(x.shape[1], setting)
                for k in range(0, len(rows), 2048):
                    unit = units(x[k : k + 2048])
                    cells = lat.cells(unit)
                    ends = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key[rows[k : k + 2048]]), pa.array(lat.signature(unit)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel().view(np.int64))),
                    ], ["key", "sig", "cells"])

    return run


def most_bits(least: float) -> int:
    """Differing sign bits up to which a pair is looked at: the mean at ``least`` and SIGMAS deviations."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(64 * p + SIGMAS * math.sqrt(64 * p * (1 - p)))


def near_pairs(cell: np.ndarray, key: np.ndarray, sig: np.ndarray, bits: int, dense: int):
    """``(cell, a, b)`` of sorted whole cells: their near pairs, or with b masked all entries of a dense cell."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(cell)]))
    sig = sig.view(np.uint64)  # of a negative number NumPy counts the bits of its absolute value
    left, right, at, d = [], [], np.arange(len(cell)), 0
    while True:
        d += 1
        at = at[at + d < len(cell)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        near = at[(np.bitwise_count(sig[at] ^ sig[at + d]) <= bits) & (key[at] != key[at + d])]
        left.append(near)
        right.append(near + d)
    if not left:
        return cell[:0], key[:0], key[:0], np.zeros(0, bool)
    a, b = np.concatenate(left), np.concatenate(right)
    full = np.bincount(run[a], minlength=len(first)) > dense * np.bincount(run, minlength=len(first))
    a, b = a[~full[run[a]]], b[~full[run[a]]]
    whole = np.flatnonzero(full[run])
    return (
        np.r_[cell[a], cell[whole]], np.r_[np.minimum(key[a], key[b]), key[whole]], np.r_[np.maximum(key[a], key[b]), key[whole]],
        np.r_[np.zeros(len(a), bool), np.ones(len(whole), bool)],
    )


def _meet(bits: int, small: int, dense: int):
    """Near pairs (cell, a, b), and entries (cell, a, null) of large and dense cells, from entries sorted by cell.

    A task holds one batch and the entries of a cell of ``small`` at most; those
    of a larger cell pass through.
    """

    def batch(cell, a, b, alone):
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(a), pa.array(b, mask=alone)], ["cell", "a", "b"])

    def run(batches):
        names = ("cell", "key", "sig")
        held, passing = [np.zeros(0, np.int64)] * 3, None
        for got in itertools.chain(batches, [None]):
            new = [np.zeros(0, np.int64)] * 3 if got is None else [got.column(c).to_numpy() for c in names]
            cell, key, sig = (np.concatenate(x) for x in zip(held, new, strict=True))
            if passing is not None and len(cell):
                n = int(np.searchsorted(cell, passing, "right"))
                yield batch(cell[:n], key[:n], key[:n], np.ones(n, bool))
                if n < len(cell):
                    passing = None
                cell, key, sig = cell[n:], key[n:], sig[n:]
            cut = len(cell) if got is None or not len(cell) else int(np.searchsorted(cell, cell[-1]))
            size = np.diff(np.flatnonzero(np.r_[True, cell[1:cut] != cell[: max(cut - 1, 0)], True])) if cut else np.zeros(0, np.int64)
            big = np.repeat(size > small, size)
            c, k, s = cell[:cut], key[:cut], sig[:cut]
            yield batch(c[big], k[big], k[big], np.ones(int(big.sum()), bool))
            alone = np.repeat(size < 2, size)
            some = ~(big | alone)
            if some.any():
                yield batch(*near_pairs(c[some], k[some], s[some], bits, dense))
            held = [cell[cut:], key[cut:], sig[cut:]]
            if len(held[0]) > small:
                passing = held[0][0]
                yield batch(held[0], held[1], held[1], np.ones(len(held[0]), bool))
                held = [x[:0] for x in held]

    return run


def block_links(unit: np.ndarray, part: np.ndarray, weight: np.ndarray, cells: list[np.ndarray], cell: np.int64, least: float):
    """``(linked weight, spanning links)`` of the pairs whose smallest common cell is ``cell``."""
    m = len(unit)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if part.any():
        near &= part[:, None] != part[None, :]
    some = np.flatnonzero(near.any(1))
    if len(some):  # pairs that meet in a smaller cell count there
        lower = [c[c < cell] for c in (cells[i] for i in some)]
        flat = np.concatenate(lower)
        row = np.repeat(some, [len(c) for c in lower])
        names, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[inv] > 1
        names, inv = np.unique(inv[keep], return_inverse=True)
        row = row[keep]
        for a in range(0, len(names), 2048):
            sel = (inv >= a) & (inv < a + 2048)
            has = np.zeros((m, min(2048, len(names) - a)), np.float32)
            has[row[sel], inv[sel] - a] = 1
            near &= has @ has.T == 0
    links = near @ weight
    label, out = np.arange(m), []
    for a in range(m):
        b = np.flatnonzero(near[a] & (label != label[a]))
        while len(b):
            out.append((a, int(b[0])))
            x, y = sorted((label[a], label[b[0]]))
            label[label == y] = x
            b = b[label[b] != label[a]]
    return links, out


def pair_links(unit: np.ndarray, key: np.ndarray, task: np.ndarray, weight: np.ndarray, partners: list, large: list, least: float):
    """``(linked weight, links)`` of the listed pairs of many tasks at once, without those that share a large cell."""
    keys, kid = np.unique(key, return_inverse=True)
    _, tid = np.unique(task, return_inverse=True)
    place = tid * len(keys) + kid
    order = np.argsort(place, kind="stable")
    place = place[order]
    a = np.repeat(np.arange(len(key)), [len(p) for p in partners])
    other = np.concatenate(partners) if partners else key[:0]
    spot = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
    want = tid[a] * len(keys) + spot
    at = np.minimum(np.searchsorted(place, want), len(place) - 1)
    ok = (keys[spot] == other) & (place[at] == want)
    a, b = a[ok], order[at[ok]]
    near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
    a, b = a[near], b[near]
    both = np.array([len(large[x]) > 0 and len(large[y]) > 0 and len(np.intersect1d(large[x], large[y])) > 0 for x, y in zip(a, b, strict=True)], bool)
    a, b = a[~both], b[~both]
    links = np.zeros(len(key), np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    return links, list(zip(a.tolist(), b.tolist(), strict=True))


def _batched(batches, rows: int):
    """Tables of one large task, or of many pair tasks together."""
    held, n = [], 0
    for t in groups(batches, "task"):
        alone = t.column("partners").is_null()
        if t.column("partners").null_count:
            yield t.filter(alone)
            t = t.filter(pa.compute.invert(alone))
        held.append(t)
        n += t.num_rows
        if n >= rows:
            yield pa.concat_tables(held)
            held, n = [], 0
    if n:
        yield pa.concat_tables(held)


def _arrays(col: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column; null ones are empty."""
    col = col.combine_chunks()
    off, flat = col.offsets.to_numpy(), col.values.to_numpy()
    return [flat[i:j] if v else flat[:0] for i, j, v in zip(off[:-1], off[1:], col.is_valid().to_pylist(), strict=True)]


def _compare(least: float):
    def run(batches):
        for t in _batched(batches, 4096):
            lists = {c: _arrays(t.column(c)) for c in ("partners", "large")}
            key, weight, task = (t.column(c).to_numpy() for c in ("key", "weight", "task"))
            for rows, x in by_length(t.column("embedding")):
                unit, pick = units(x), lambda c: [lists[c][k] for k in rows]  # noqa: B023
                if t.column("partners").null_count:
                    part = t.column("part").to_numpy()[rows]
                    links, span = block_links(unit, part, weight[rows], pick("large"), t.column("cell")[0].as_py(), least)
                else:
                    links, span = pair_links(unit, key[rows], task[rows], weight[rows], pick("partners"), pick("large"), least)
                own, some = key[rows], np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[own[some], own[[a for a, _ in span]]].astype(np.int64)),
                    pa.array(np.r_[links[some], np.zeros(len(span), np.int64)]),
                    pa.array([None] * len(some) + [int(own[b]) for _, b in span], pa.int64()),
                ], ["key", "links", "other"])

    return run


def _tasks(met: DataFrame, ws: Workspace, block: int) -> DataFrame:
    """``(key, task, part, cell, partners, large)``: where each vector is compared, and with which listed partners."""
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.min("cell").alias("cell"))
    ends = pairs.select("cell", F.col("a").alias("key"), F.col("b").alias("other")).unionByName(
        pairs.select("cell", F.col("b").alias("key"), F.lit(None).cast("long").alias("other"))
    )
    listed = ends.groupBy("cell", "key").agg(F.collect_list("other").alias("partners"))
    listed = listed.select("key", F.col("cell").alias("task"), F.lit(0).alias("part"), "cell", "partners")
    large = met.where("b is null").select("cell", F.col("a").alias("key"))
    if large.isEmpty():
        return ws.table(listed.withColumn("large", F.lit(None).cast("array<bigint>")), "tasks")
    blocks = ws.table(large.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    if blocks.count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    pair = lambda j: F.struct(
        F.xxhash64("cell", F.least("own", j), F.greatest("own", j)).alias("task"), (F.col("own") > j).cast("int").alias("part")
    )
    whole = large.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("key", "cell"), F.col("blocks")).cast("int"))
    whole = whole.select("key", "cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("t"))
    whole = whole.select("key", "t.task", "t.part", "cell", F.lit(None).cast("array<bigint>").alias("partners"))
    lists = large.groupBy("key").agg(F.sort_array(F.collect_set("cell")).alias("large"))  # no longer than a vector's cells
    return ws.table(listed.unionByName(whole).join(lists, "key", "left"), "tasks")


def _links(keyed: DataFrame, n: int, ws: Workspace, least: float, setting: Setting | None, small: int, dense: int, block: int) -> DataFrame:
    """``(key, links, other)``: linked weight of each vector, and a spanning set of links."""
    entry = keyed.select("key", "embedding").mapInArrow(_cells(setting or setting_for(n)), "key bigint, sig bigint, cells array<bigint>")
    entry = entry.select("key", "sig", F.explode("cells").alias("cell")).repartition("cell").sortWithinPartitions("cell", "key")
    met = ws.table(entry.mapInArrow(_meet(most_bits(least), small, dense), "cell bigint, a bigint, b bigint"), "met")
    tasks = _tasks(met, ws, block)
    ws.drop(met)
    side = F.broadcast(tasks) if tasks.count() <= BROADCAST_ROWS else tasks
    shipped = keyed.join(side, "key").repartition("task").sortWithinPartitions("task")
    found = ws.table(shipped.mapInArrow(_compare(least), "key bigint, links bigint, other bigint"), "found")
    ws.drop(tasks)
    return found


def lattice_near_duplicates(vectors: DataFrame, ws: Workspace, least: float = COSINE, setting: Setting | None = None,
                            small: int = SMALL, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector.

    Where no vector and no vec_id repeats, vectors are read from ``vectors``
    whenever they are needed; else one of each class is written first.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    ids = ws.table(src.mapInArrow(_fingerprint("vec_id"), "vec_id bigint, digest binary"), "ids")
    valid = ids.where("digest is not null and vec_id is not null")
    classes = ws.table(valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    n, rows = classes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    plain = n == rows == classes.select("rep").distinct().count()
    if plain:
        keyed = src.where("vec_id is not null").select(F.col("vec_id").alias("key"), "embedding", F.lit(1).cast("long").alias("weight"))
        found = _links(keyed, n, ws, least, setting, small, dense, block)
        edges = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
        links = found.groupBy(F.col("key").alias("vec_id")).agg(F.sum("links").alias("links"))
        comp = components(edges, "a", "b", ws)
        out = ids.select("vec_id").join(links, "vec_id", "left").join(comp, F.col("vec_id") == F.col("node"), "left")
        component = F.coalesce("component", "vec_id")
        return out.select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        )
    marked = src.mapInArrow(_fingerprint("vec_id", "embedding"), f"vec_id bigint, embedding {kind}, digest binary")
    first = marked.where("digest is not null and vec_id is not null").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
    )
    keyed = ws.table(first.withColumn("key", F.monotonically_increasing_id()), "keyed")
    found = _links(keyed.select("key", "embedding", "weight"), n, ws, least, setting, small, dense, block)
    name = keyed.select("key", "rep")
    edges = (
        found.where("other is not null").join(name.withColumnRenamed("rep", "a"), "key")
        .join(name.select(F.col("key").alias("other"), F.col("rep").alias("b")), "other").select("a", "b")
    )
    # an id with several vectors ties their classes together
    several = valid.groupBy("vec_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("vec_id")
    tied = valid.join(several, "vec_id", "left_semi").distinct().join(classes, "digest").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.unionByName(tied), "a", "b", ws)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    label = (
        keyed.select("digest", "key", "rep", "weight").join(links, "key", "left").join(comp, F.col("rep") == F.col("node"), "left")
        .select("digest", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    label = ws.table(label, "label")
    out = join_classes(valid, label, ["digest"], "weight", rows).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = ids.where("digest is null or vec_id is null")
    return out.unionByName(rest.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    ))


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op1"))
