"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every document gets its set of word shingles and the ``SKETCH`` smallest
   shingle hashes.  Documents with equal sets form a class; only the class's
   smallest doc_id goes on.
2. Inverted lists of the retained values generate overlaps.  A class enters the
   lists of its rarest values only: so many that two sketches with the overlap
   that the threshold implies must share one of them (prefix filtering).
3. Classes that meet in a list, directly or through others, form a candidate
   cluster.  Inside a cluster (cut into blocks and block pairs when it is large)
   sketch overlap and the union-sketch estimate filter pairs, and the full sets
   confirm them.  Pairs already connected are skipped and only spanning links
   leave the task, so a group of m near copies never becomes m^2 rows.
4. Components of the links.

Cases: null, empty and blank texts have an empty set and link with nothing;
rows that share a doc_id count as one node; rows with a null doc_id take their
class's component (null without one) and never link others (the pipeline's stage
tells rows apart instead); extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.rownumbers import ids_name_rows, numbered
from cohortvox.llm.textcore import NONSPACE, bound_batches, groups, mix, text_chunks, word_hashes
from cohortvox.operators.graph import components
from cohortvox.operators.hotjoin import join_classes
from cohortvox.sources.workspace import Workspace

#: Words of a shingle: op9's contract, and the pipeline's stage.
SHINGLE = 4
STAGE_SHINGLE = 5
#: A link: 100 * intersection >= 80 * union.
PERCENT = 80
#: Values retained of each set.
SKETCH = 64
#: Retained values that two linked sets share at least: five standard deviations
#: of a binomial(64, 0.8) below its mean.
OVERLAP = 35
#: Up to this size a set and every set linked with it are retained whole.
WHOLE = int(SKETCH * PERCENT / 100)
#: Shared values of linked sets just above WHOLE, of which a few can be dropped.
NEARLY = 45
#: Shingles and documents of one block; a larger cluster is compared by pairs of blocks.
BLOCK_SHINGLES = 1_000_000
BLOCK_DOCS = 4_096
#: Candidate classes' tasks (about 40 bytes each) up to which they are broadcast to the texts.
BROADCAST_ROWS = 500_000


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a run."""
    row, h = word_hashes(data, off, NONSPACE)
    n = np.bincount(row, minlength=len(off) - 1)
    begin = np.r_[0, np.cumsum(n)]
    with np.errstate(over="ignore"):
        last = np.repeat(begin[1:], n)
        at = np.arange(len(h))
        s = np.full(len(h), 0x51ED270B, np.uint64)
        for k in range(shingle):
            word = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
            s = np.where(at + k < last, mix(s * np.uint64(0x9E3779B97F4A7C15) + word), s)
    return [np.unique(s[a : max(a + 1, b - shingle + 1)]) if b > a else s[:0] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """``(doc_id, n, f1, f2, sketch)``: set size, fingerprint of the set, smallest hashes."""

    def run(batches):
        for batch in batches:
            for i, j, off, data in text_chunks(batch.column("text")):
                sets = shingle_sets(data, off, shingle)
                with np.errstate(over="ignore"):
                    f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                    f2 = np.array([mix(s + np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _lists([s[:k] for s in sets]),
                ], ["doc_id", "n", "f1", "f2", "sketch"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id bigint, n int, f1 bigint, f2 bigint, sketch array<bigint>")


def candidate_lists(reps: DataFrame, ws: Workspace) -> DataFrame:
    """``(value, rep)``: each class in the lists of its rarest shared values.

    Value counts are written first, so that a value of very many classes is
    broadcast to them or its rows split, instead of meeting in one task.
    """
    post = reps.select("rep", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    many = ws.table(post.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "many")
    rows = many.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shared = join_classes(post, many, ["value"], "df", rows, "inner").groupBy("rep", "n", "k").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("s"))
    need = (
        F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * PERCENT / 100))
        .when(F.col("n") < SKETCH, F.lit(NEARLY)).otherwise(F.lit(OVERLAP))
    )
    # values held by this class alone come first in the rarest-first order
    shared = shared.withColumn("take", (F.size("s") - need + 1).cast("int"))
    lists = shared.where("take > 0").select("rep", F.explode(F.slice("s", F.lit(1), F.col("take"))).alias("s")).select(F.col("s.value").alias("value"), "rep")
    out = ws.table(lists, "lists")
    ws.drop(many)
    return out


class Forest:
    """Union-find over 0..n-1 whose labels can be read as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, bs: np.ndarray) -> list[int]:
        """Joins ``a`` with each of ``bs``; returns those that were not connected yet."""
        new = []
        for b in bs.tolist():
            x, y = self.label[a], self.label[b]
            if x != y:
                self.label[self.label == max(x, y)] = min(x, y)
                new.append(b)
        return new


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-sketch estimates: ``a`` one padded sketch, ``b`` one per row."""
    both = np.sort(np.concatenate([np.broadcast_to(a, b.shape), b], axis=1), axis=1)
    real = both != np.uint64(2**64 - 1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    inside = rank <= SKETCH
    return (twice & inside).sum(1) / np.maximum(1, np.minimum(rank[:, -1], SKETCH))


def block_links(nodes: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning links among sets of one block, or between the two parts of a block pair."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    values, ids = np.unique(flat, return_inverse=True)
    begin = np.r_[0, np.cumsum(n)]
    small = np.full((m, SKETCH), 2**64 - 1, np.uint64)
    for k, s in enumerate(sets):
        small[k, : min(SKETCH, len(s))] = s[:SKETCH]
    place = np.searchsorted(values, small)  # padding goes to the last, unused, flag
    flag = np.zeros(len(values) + 1, bool)
    two = bool(part.any())
    forest, out = Forest(m), []
    low = np.where(n <= WHOLE, np.ceil(n * percent / 100), np.where(n < SKETCH, NEARLY, OVERLAP)).astype(np.int64)
    for a in range(m):
        ok = (forest.label != forest.label[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        ok[: a + 1] = False
        if two:
            ok &= part != part[a]
        b = np.flatnonzero(ok)
        if not len(b):
            continue
        mine = place[a, : min(SKETCH, n[a])]
        flag[mine] = True
        b = b[flag[place[b]].sum(1) >= np.minimum(low[a], low[b])]
        flag[mine] = False
        if len(b):
            b = b[_estimate(small[a], small[b]) >= OVERLAP / SKETCH]
        if not len(b):
            continue
        own = ids[begin[a] : begin[a + 1]]
        flag[own] = True
        idx = np.concatenate([ids[begin[x] : begin[x + 1]] for x in b])
        both = np.add.reduceat(flag[idx], np.r_[0, np.cumsum(n[b])[:-1]], dtype=np.int64)
        flag[own] = False
        linked = b[100 * both >= percent * (n[a] + n[b] - both)]
        out += [(int(nodes[a]), int(nodes[x])) for x in forest.join(a, linked)]
    return out


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task"):
            sets = []
            for _, _, off, data in text_chunks(t.column("text")):
                sets += shingle_sets(data, off, shingle)
            links = block_links(t.column("rep").to_numpy(), t.column("part").to_numpy(), sets, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _tasks(cluster: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``(rep, tasks)``: the block pairs in which each candidate class is compared."""
    sized = cluster.join(sizes, cluster["node"] == sizes["rep"]).select("rep", "component", "n")
    blocks = sized.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / block, F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")
    pair = lambda j: F.struct(
        F.xxhash64("component", F.least("own", j), F.greatest("own", j)).alias("task"),
        ((F.col("own") > j)).cast("int").alias("part"),
    )
    return sized.join(blocks, "component").withColumn("own", own).select("rep", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair).alias("tasks"))


def near_duplicates(docs: DataFrame, ws: Workspace, shingle: int = SHINGLE, percent: int = PERCENT,
                    block: int = BLOCK_SHINGLES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document."""
    bound_batches(docs.sparkSession)
    all_ = ws.table(sketches(docs, shingle), "sketches")
    classes = ws.table(
        all_.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2")
        .agg(F.min(F.struct("doc_id", "sketch")).alias("r"), F.count("*").alias("rows"))
        .select("n", "f1", "f2", F.col("r.doc_id").alias("rep"), F.col("r.sketch").alias("sketch"), "rows"),
        "classes",
    )
    lists = candidate_lists(classes.select("rep", "n", "sketch"), ws)
    lead = ws.table(lists.groupBy("value").agg(F.min("rep").alias("lead"), F.count("*").alias("c")).where("c > 1"), "lead")
    rows = lead.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    met = join_classes(lists, lead, ["value"], "c", rows, "inner").where("rep <> lead")
    cluster = components(met.select("rep", "lead"), "rep", "lead", ws)
    tasks = ws.table(_tasks(cluster, classes.groupBy("rep").agg(F.max("n").alias("n")), block), "tasks")
    ws.drop(lists, lead)
    n_tasks = tasks.agg(F.coalesce(F.sum(F.size("tasks")), F.lit(0))).first()[0]  # also when few classes have many tasks
    side = F.broadcast(tasks) if n_tasks <= broadcast_rows else tasks
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = (
        src.join(side, src["doc_id"] == side["rep"])
        .select("rep", "text", F.explode("tasks").alias("t")).select("rep", "text", "t.task", "t.part")
        .repartition("task").sortWithinPartitions("task")
    )
    links = ws.table(blocks.mapInArrow(_verify(shingle, percent), "a bigint, b bigint"), "links")
    found = components(links, "a", "b", ws)
    ws.drop(tasks, links)
    label = classes.select("n", "f1", "f2", "rep", "rows").join(found, F.col("rep") == F.col("node"), "left").select(
        "n", "f1", "f2", "rows", F.coalesce("component", "rep").alias("component")
    )
    label = ws.table(label, "label")
    rows = label.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = all_.select("doc_id", "n", "f1", "f2")
    out = join_classes(out.where("n > 0"), label, ["n", "f1", "f2"], "rows", rows).select("doc_id", "n", "component").unionByName(
        out.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    )
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op9_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op9"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the one with the smallest doc_id.

    Where ids are null or repeat, rows are numbered and the first row of each
    group in the order (doc_id with nulls last, hash of the text) stays, so other
    texts under a repeated id are neither joined nor lost.  Rows without words
    all stay.  Shingles are of five words here, as for any near-duplicate stage;
    the four of op9's contract bind that query.
    """
    ws = Workspace(spark, "dedup")
    if not ids_name_rows(docs):
        rows = numbered(docs, ws)
        gone = ws.table(near_duplicates(rows.select("doc_id", "text"), ws, STAGE_SHINGLE).where("not kept").select(F.col("doc_id").alias("__gone")), "gone")
        return rows.join(gone, rows["doc_id"] == gone["__gone"], "left_anti").select("row.*")
    gone = near_duplicates(docs, ws, STAGE_SHINGLE).where("not kept").select(F.col("doc_id").alias("__gone"))
    gone = ws.keep(gone, "gone", BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
