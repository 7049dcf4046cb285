"""A stored index of vectors in cells around centres, and exact nearest neighbours through it.

Centres are fitted on a bounded sample; every vector is stored with its cell and
its distance from the cell's centre, rows of a cell next to each other.  A
search looks into the nearest cells of each query first; the k-th distance found
there bounds the rest: by the triangle inequality a vector can only be nearer if
its distance from its centre differs from the query's by less.  Cells and vectors
outside that bound are not compared, and the result equals that of all pairs.
Without the second step (``exact=False``) the recall depends on the probes; the
tests measure it on clustered vectors.

Vectors that are null, hold nulls or have another length than most are not
stored.  A tie in distance goes to the lesser id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortvox.sources.workspace import Workspace

#: Vectors that centres are fitted on at most, centres at most, and rounds of fitting.
SAMPLE = 20_000
CENTRES = 1_024
ROUNDS = 8
#: Cells that a query looks into first.
PROBES = 4
#: Queries and bytes of them that one pass over the index takes.
BATCH_QUERIES = 100_000
BATCH_BYTES = 64 << 20
#: Distances that a task computes at once.
PAIRS = 1 << 18


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres, without cancellation, block by block."""
    out = np.empty((len(points), len(centres)))
    step = max(1, (1 << 22) // max(centres.size, 1))
    for a in range(0, len(points), step):
        out[a : a + step] = ((points[a : a + step, None, :] - centres[None]) ** 2).sum(-1)
    return out


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a centre without rows stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        cell = np.concatenate([_near(part, centres).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 1000))])
        n = np.bincount(cell, minlength=count)
        for d in range(sample.shape[1]):
            total = np.bincount(cell, sample[:, d], count)
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return np.unique(centres, axis=0)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.values.to_numpy()[col.offsets[0].as_py() : col.offsets[-1].as_py()].reshape(-1, width)


def build(vectors: DataFrame, folder: str, cells: int | None = None) -> None:
    """Writes the index of (id, v array<double>, other columns) to ``folder``."""
    spark = vectors.sparkSession
    known = vectors.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x))")
    sizes = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width, n = (sizes.d, sizes["count"]) if sizes else (0, 0)
    known = known.where(F.size("v") == width)
    sample = known.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("v").combine_chunks()
    count = min(cells or int(np.sqrt(n)), CENTRES, len(sample)) if n else 0
    centres = fit_centres(_matrix(sample, width), max(count, 1)) if n else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), width)
            d = _near(v, shared.value)
            cell = d.argmin(1)
            arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(v)), cell]))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "cell", "r"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    rows = known.mapInArrow(assign, f"{fields}, cell int, r double") if n else known.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("r"))
    rows.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/vectors")
    stored = spark.read.parquet(f"{folder}/vectors")
    reach = {r.cell: r.far for r in stored.groupBy("cell").agg(F.max("r").alias("far")).collect()}  # one row per centre
    head = [(k, c.tolist(), float(reach[k])) for k, c in enumerate(centres) if k in reach]
    spark.createDataFrame(head, "cell int, centre array<double>, far double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(folder + "/done")


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.rows = spark, spark.read.parquet(f"{folder}/vectors")
        head = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # CENTRES rows at most
        self.cells = np.array([r.cell for r in head], np.int64)
        self.centres = np.array([r.centre for r in head], float).reshape(len(head), len(head[0].centre) if head else 0)
        self.far = np.array([r.far for r in head], float)

    def _scan(self, q: np.ndarray, wanted: np.ndarray, k: int, where: Column | None, bound: np.ndarray | None) -> DataFrame:
        """Each task's k nearest per query among the cells wanted (queries x cells), and within the bound."""
        cells = self.cells[wanted.any(0)].tolist()
        rows = self.rows.where(F.col("cell").isin(cells)) if len(cells) < len(self.cells) else self.rows
        rows = (rows if where is None else rows.where(where)).select("id", "v", "cell", "r")
        shared = self.spark.sparkContext.broadcast((q, wanted, bound, np.sqrt(_near(q, self.centres)), {c: j for j, c in enumerate(self.cells.tolist())}))

        def run(batches):
            queries, want, most, dc, place = shared.value
            best: dict[int, list] = {}
            kind = None
            for batch in batches:
                kind = batch.column("id").type
                cell, r = batch.column("cell").to_numpy(), batch.column("r").to_numpy()
                v = _matrix(batch.column("v"), queries.shape[1]) if len(cell) else None
                ids = batch.column("id")
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    qs = np.flatnonzero(want[:, place[c]])
                    step = max(1, PAIRS // max(len(at) * queries.shape[1], 1) + 1)
                    for a in range(0, len(qs), step):
                        part = qs[a : a + step]
                        if most is None:
                            i, j = np.repeat(np.arange(len(part)), len(at)), np.tile(np.arange(len(at)), len(part))
                        else:
                            i, j = np.nonzero(np.abs(dc[part, place[c]][:, None] - r[at][None]) <= most[part][:, None])
                        d = ((v[at[j]] - queries[part[i]]) ** 2).sum(1)
                        cut = np.searchsorted(i, np.arange(len(part) + 1))
                        for x in range(len(part)):
                            mine = slice(cut[x], cut[x + 1])
                            if cut[x] == cut[x + 1]:
                                continue
                            held = best.setdefault(int(part[x]), [])
                            dist = d[mine]
                            limit = held[-1][0] if len(held) == k else np.inf
                            if len(dist) > k:
                                limit = min(limit, np.partition(dist, k - 1)[k - 1])
                            ok = np.flatnonzero(dist <= limit)
                            held += [(float(dist[y]), ids[int(at[j[mine][y]])].as_py()) for y in ok]
                            held.sort()
                            del held[k:]
            if best:
                flat = [(x, i, d) for x, held in best.items() for d, i in held]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat])], ["q", "id", "distance"])

        return rows.mapInArrow(run, f"q bigint, id {self.rows.schema['id'].dataType.simpleString()}, distance double")

    def _batch(self, queries: DataFrame, k: int, where: Column | None, probes: int, exact: bool, ws: Workspace) -> DataFrame:
        got = queries.select("query", "q").toArrow()  # BATCH_QUERIES rows and BATCH_BYTES at most
        vectors = got.column("q").combine_chunks()
        names = self.spark.createDataFrame(list(enumerate(got.column("query").to_pylist())), f"q bigint, query {queries.schema['query'].dataType.simpleString()}")
        q = _matrix(vectors, self.centres.shape[1])
        dc = _near(q, self.centres)
        first = np.zeros(dc.shape, bool)
        np.put_along_axis(first, np.argsort(dc, axis=1, kind="stable")[:, :probes], True, axis=1)
        w = Window.partitionBy("q").orderBy("distance", "id")
        top = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        rows = ws.table(top(self._scan(q, first, k, where, None)).drop("rank"), "probed")
        if exact:
            bound = np.full(len(q), np.inf)
            for r in rows.groupBy("q").agg(F.max("distance").alias("d"), F.count("*").alias("n")).where(F.col("n") == k).collect():
                bound[r.q] = np.sqrt(r.d) * (1 + 1e-9)
            rest = ~first & (np.sqrt(dc) - self.far[None] <= bound[:, None])
            if rest.any():
                rows = rows.unionByName(self._scan(q, rest, k, where, bound))
        return top(rows).join(F.broadcast(names), "q").select("query", "id", "distance", "rank")

    def search(self, queries: DataFrame, k: int = 2, where: Column | None = None, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """``(query, id, distance, rank)``: the k nearest stored vectors that satisfy ``where``, of each of (query, q).

        Queries are taken in batches of a bounded size; null ones, and those of
        another length than the stored vectors, find nothing.
        """
        ws = Workspace(self.spark, "search")
        usable = queries.where(F.size("q") == (self.centres.shape[1] if len(self.cells) else -2)).where("not exists(q, x -> x is null or isnan(x))")
        n = usable.count()
        blocks = max(1, -(-n // max(1, min(BATCH_QUERIES, BATCH_BYTES // max(8 * (self.centres.shape[1] + len(self.cells)), 1)))))
        out = None
        for b in range(blocks if n else 0):
            q = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
            if blocks > 1 and q.isEmpty():
                continue
            part = self._batch(q, k, where, probes, exact, ws)
            out = part if out is None else out.unionByName(part)
        if out is None:
            kinds = (queries.schema["query"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString())
            return self.spark.createDataFrame([], f"query {kinds[0]}, id {kinds[1]}, distance double, rank int")
        return out


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether an index was built there as a whole."""
    return Workspace(spark, "search").exists(folder + "/done")
