"""Connected components of masks, and what follows from them.

A grid is cut into blocks of BLOCK cells a side.  Components within a block are
found in one task; what remains is a graph of block labels that touch across
block borders, which is contracted on Spark.  A case that fits one block needs
no graph at all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortvox.operators.graph import components
from cohortvox.sources.workspace import Workspace

#: Cells of a block along each axis.
BLOCK = 64
#: Labels of components that cross blocks up to which they are broadcast.
BROADCAST_LABELS = 100_000
#: A component's number is its case's number * CASE + its first cell in (z, y, x) order.
CASE = 1 << 32


def neighbours(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the (dx, dy, dz) of touching cells: by faces (6), edges too (18) or corners too (26)."""
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    return [d[::-1] for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0) and sum(map(abs, d)) <= reach]


def merged(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes: hooks roots onto smaller ones, then shortens all paths."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def block_labels(x: np.ndarray, y: np.ndarray, z: np.ndarray, connectivity: int) -> np.ndarray:
    """For each cell of one block the place (in the given order) of the first cell of its component, by (z, y, x)."""
    order = np.lexsort((x, y, z))
    lo = np.array([z.min(), y.min(), x.min()]) - 1
    shape = np.array([z.max(), y.max(), x.max()]) - lo + 2
    at = np.ravel_multi_index((z[order] - lo[0], y[order] - lo[1], x[order] - lo[2]), shape)
    place = np.full(int(np.prod(shape)), -1)
    place[at] = np.arange(len(at))
    pairs = []
    for dx, dy, dz in neighbours(connectivity):
        other = place[at + (dz * shape[1] + dy) * shape[2] + dx]
        here = np.flatnonzero(other >= 0)
        pairs.append((here, other[here]))
    root = merged(len(at), *map(np.concatenate, zip(*pairs)))
    out = np.empty(len(at), int)
    out[order] = order[root]
    return out


_KEY = ["case_id", "bx", "by", "bz"]


def _label_blocks(connectivity: int):
    """Adds ``local``, the first cell's number, to cells that come block by block."""

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        cell = t.column("cell").to_numpy()
        first = block_labels(*(t.column(a).to_numpy() for a in "xyz"), connectivity)
        t = t.append_column("local", pa.array(cell[first]))
        return t.to_batches()[0]

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            case = batch.column("case_id").dictionary_encode()
            code = np.stack([case.indices.to_numpy(), *[batch.column(c).to_numpy() for c in _KEY[1:]]])
            cuts = np.r_[0, np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                key = (case.dictionary[int(code[0, a])].as_py(), *code[1:, a].tolist())
                if held and key != last:
                    yield done(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held)

    return run


def _case_numbers(cells: DataFrame) -> DataFrame:
    """``cells`` with ``number``: the case's id where it is a whole number below 2^31, else its rank (one row a case is sorted)."""
    whole = cells.schema["case_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    if whole:
        most = cells.agg(F.max(F.greatest(F.col("case_id").cast("long"), -(F.col("case_id").cast("long") + 1)))).first()[0]
        if most is None or most < CASE // 2:
            return cells.withColumn("number", F.col("case_id").cast("long"))
    ranks = cells.select("case_id").distinct().withColumn("number", F.row_number().over(Window.orderBy("case_id")).cast("long"))
    return cells.join(ranks, "case_id")


def _across(parts: DataFrame, connectivity: int, ws: Workspace) -> DataFrame | None:
    """``(case_id, local, whole)`` of the block labels whose component reaches other blocks; None where there is no such border."""
    if parts.where("bx > 0 or by > 0 or bz > 0").isEmpty():
        return None
    edge = F.lit(False)
    for a in "xyz":
        edge = edge | F.pmod(a, F.lit(BLOCK)).isin(0, BLOCK - 1)
    border = parts.where(edge).select("case_id", "x", "y", "z", "bx", "by", "bz", "local")
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("xyz", d)]) for d in neighbours(connectivity)])
    near = border.withColumn("s", F.explode(steps)).select("case_id", *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in "xyz"], *[F.col(f"b{a}").alias(f"c{a}") for a in "xyz"], F.col("local").alias("from"))
    other = F.lit(False)
    for a in "xyz":
        other = other | (F.expr(f"{a} div {BLOCK}") != F.col(f"c{a}"))
    pairs = near.where(other).join(border.select("case_id", "x", "y", "z", "local"), ["case_id", "x", "y", "z"]).select("case_id", "from", "local").distinct()
    pairs = ws.table(pairs, "pairs")
    nodes = pairs.select("case_id", F.col("from").alias("local")).unionByName(pairs.select("case_id", "local")).distinct()
    nodes = ws.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = pairs.join(nodes.select("case_id", F.col("local").alias("from"), F.col("node").alias("a")), ["case_id", "from"]).join(nodes.withColumnRenamed("node", "b"), ["case_id", "local"])
    found = nodes.join(components(named.select("a", "b"), "a", "b", ws), "node")
    first = found.groupBy("component").agg(F.min("local").alias("whole"))
    out = ws.table(found.join(first, "component").select("case_id", "local", "whole"), "across")
    return F.broadcast(out) if out.count() <= BROADCAST_LABELS else out.hint("merge")


def _wholes(df: DataFrame, mask: Column, ws: Workspace, connectivity: int, keep: list[str]) -> DataFrame:
    """The mask's voxels with ``whole``, the first cell of their component, and the columns ``keep``.

    These pass through the labelling with their voxel; a join back to the grid
    would be planned by the written table's compressed size and broadcast.
    """
    cells = df.where(mask).select(
        "case_id", *[F.col(a).cast("long").alias(a) for a in "xyz"], *[F.expr(f"cast({a} div {BLOCK} as bigint)").alias(f"b{a}") for a in "xyz"],
        F.expr("cast((z * ny + y) * nx + x as bigint)").alias("cell"), *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    parts = cells.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_label_blocks(connectivity), f"{kinds}, local bigint")
    parts = ws.table(parts, "parts")
    across = _across(parts, connectivity, ws)
    whole = parts.withColumn("whole", F.col("local")) if across is None else parts.join(across, ["case_id", "local"], "left").withColumn("whole", F.coalesce("whole", "local"))
    return whole.select("case_id", "x", "y", "z", "whole", *[F.col(f"keep_{c}").alias(c) for c in keep])


def label(df: DataFrame, mask: Column, ws: Workspace, connectivity: int = 26, name: str = "component") -> DataFrame:
    """The mask's voxels with their component: the case's number * CASE + the component's first cell."""
    rest = [c for c in df.columns if c not in ("case_id", "x", "y", "z", name)]
    named = _case_numbers(_wholes(df, mask, ws, connectivity, rest))
    return named.select("case_id", "x", "y", "z", (F.col("number") * CASE + F.col("whole")).alias(name), *rest)


def count_parts(df: DataFrame, mask: Column, ws: Workspace) -> DataFrame:
    """``(case_id, parts)``: how many components the mask has; cases without any are left out."""
    return _wholes(df, mask, ws, 26, []).select("case_id", "whole").distinct().groupBy("case_id").agg(F.count("*").alias("parts"))


def hole_voxels(df: DataFrame, mask: Column, ws: Workspace) -> DataFrame:
    """``(case_id, hole_voxels)``: voxels outside the mask in 6-components that do not reach the grid's border; cases without any are left out."""
    edge = F.lit(False)
    for a in "xyz":
        edge = edge | (F.col(a) == 0) | (F.col(a) == F.col(f"n{a}") - 1)
    bg = _wholes(df.withColumn("edge", edge), ~mask, ws, 6, ["edge"])
    shut = bg.groupBy("case_id", "whole").agg(F.count("*").alias("n"), F.max("edge").alias("open")).where(~F.col("open"))
    return shut.groupBy("case_id").agg(F.sum("n").alias("hole_voxels"))


def hole_fraction(df: DataFrame, mask: Column, ws: Workspace) -> DataFrame:
    """``(case_id, hole_voxels, hole_fraction)``."""
    h = hole_voxels(df, mask, ws)
    n = df.groupBy("case_id").agg(F.count_if(mask).alias("n"))
    v = F.coalesce("hole_voxels", F.lit(0)).cast("long")
    return n.join(h, "case_id", "left").select("case_id", v.alias("hole_voxels"), F.when(F.col("n") > 0, v / F.col("n")).otherwise(0.0).alias("hole_fraction"))


#: Fixed values of the lesion rules.
MIN_LESION_CM3 = 0.1
SATELLITE_MM = 20
SEPARATE_MM = 40


def component_stats(labelled: DataFrame, name: str = "component") -> DataFrame:
    """Per component: voxels, volume, centroid, largest extent in mm, composition; ``scan`` is its first cell."""
    g = labelled.groupBy("case_id", name)
    size = F.greatest(*[(F.max(a) - F.min(a)) * F.first(f"d{a}") for a in "xyz"])
    return g.agg(
        F.count("*").alias("voxels"), (F.count("*") * F.first(F.col("dx") * F.col("dy") * F.col("dz")) / 1000).alias("volume_cm3"),
        *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[(F.avg(a) * F.first(f"d{a}")).alias(f"m{a}") for a in "xyz"], size.alias("max_diameter_mm"),
        *[F.count_if(F.col("seg") == k).alias(n) for n, k in (("ncr", 1), ("ed", 2), ("et", 3))],
        F.min((F.col("x") * F.col("ny") + F.col("y")) * F.col("nz") + F.col("z")).alias("scan"),
    )


def lesions(stats: DataFrame, least_cm3: float = MIN_LESION_CM3) -> DataFrame:
    """Components of at least ``least_cm3``, ranked by volume (then scan order), and their class."""
    w = Window.partitionBy("case_id").orderBy(F.desc("volume_cm3"), "scan")
    out = stats.where(F.col("volume_cm3") >= least_cm3).withColumn("rank", F.row_number().over(w))
    return out.withColumn("classification", F.when(F.col("rank") == 1, "Primary lesion").otherwise(F.concat(F.lit("Secondary lesion #"), F.col("rank") - 1)))


def distance_class(mm: Column) -> Column:
    return F.when(mm < SATELLITE_MM, "Satellite/adjacent").when(mm < SEPARATE_MM, "Regional spread").otherwise("Distant/separate")


def lesion_pairs(ranked: DataFrame) -> DataFrame:
    """All pairs of a case's lesions with the distance of their centroids in mm."""
    cols = ["rank", "mx", "my", "mz"]
    a = ranked.select("case_id", *[F.col(c).alias(f"{c}1") for c in cols])
    b = ranked.select("case_id", "volume_cm3", "et", *[F.col(c).alias(f"{c}2") for c in cols])
    d = F.sqrt(sum((F.col(f"m{c}1") - F.col(f"m{c}2")) ** 2 for c in "xyz"))
    return a.join(b, "case_id").where("rank1 < rank2").withColumn("distance_mm", d).withColumn("relationship", distance_class(F.col("distance_mm")))


def multiplicity(cases: DataFrame, stats: DataFrame, foci: DataFrame, least_cm3: float = MIN_LESION_CM3) -> DataFrame:
    """Per case: lesion count, distances, satellites, enhancing foci and the distribution pattern."""
    ranked = lesions(stats, least_cm3)
    pairs = lesion_pairs(ranked).groupBy("case_id").agg(
        F.min("distance_mm").alias("min_mm"), F.max("distance_mm").alias("max_mm"), F.avg("distance_mm").alias("mean_mm"),
        F.count_if((F.col("rank1") == 1) & (F.col("distance_mm") < SATELLITE_MM)).alias("satellites"),
    )
    n = ranked.groupBy("case_id").agg(F.count("*").alias("lesions"))
    frag = stats.where(F.col("volume_cm3") < least_cm3).groupBy("case_id").agg(F.count("*").alias("fragments"))
    f = foci.groupBy("case_id").agg(F.count("*").alias("foci"), F.sum("volume_cm3").alias("enhancing_cm3"))
    j = cases.select("case_id").distinct()
    for t in (n, frag, pairs, f):
        j = j.join(t, "case_id", "left")
    j = j.fillna(0, ["lesions", "fragments", "satellites", "foci"]).fillna(0.0, ["enhancing_cm3"])
    k, far = F.col("lesions"), F.col("max_mm")
    pattern = (
        F.when(k == 0, "No tumor").when(k == 1, "Solitary").when(F.col("satellites") > 0, "Primary with satellites")
        .when((k <= 3) & (far > 0) & (far < SEPARATE_MM), "Regional multifocal").when(k <= 3, "Distant multifocal").otherwise("Diffuse/scattered")
    )
    foci_pattern = F.when(F.col("foci") == 0, "Non-enhancing").when(F.col("foci") == 1, "Single enhancing focus").when(F.col("foci") <= 3, "Few enhancing foci").otherwise("Multiple/scattered enhancing foci")
    note = (
        F.when(k == 0, None).when(F.col("foci") == 0, "Non-enhancing pattern may suggest low-grade pathology")
        .when(F.col("foci") > k, "Multiple enhancing foci within lesions suggest heterogeneous enhancement").otherwise("Enhancement pattern consistent with lesion count")
    )
    return j.withColumn("pattern", pattern).withColumn("foci_pattern", foci_pattern).withColumn("enhancement_note", note)


def central_large(stats: DataFrame, geometry: DataFrame, least: int = 1000, share: float = 0.3) -> DataFrame:
    """Components with more than ``least`` voxels whose centre lies near the middle in x."""
    j = stats.join(geometry.select("case_id", "nx"), "case_id")
    return j.where((F.col("voxels") > least) & (F.abs(F.col("cx") - F.col("nx") / 2) < share * F.col("nx"))).drop("nx")
