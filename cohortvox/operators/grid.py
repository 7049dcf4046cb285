"""Grid operators on dense voxel tables as passes along one axis at a time.

A pass sees one grid line (a case and two fixed coordinates), so the work splits
over lines and no task holds a volume.  Where the table says that every case is
at most WHOLE cells (``sources.voxels.cells_of``), a case is one block instead:
all passes of a call are made on it after one shuffle by case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortvox.sources.voxels import most_cells

AXES = ("x", "y", "z")
#: Farther than any cell of a grid.
FAR = 1_000_000
#: Cells of whole lines (or blocks) that a task handles at once.
CELLS = 1 << 17
#: Cells of a case up to which it is one block.
WHOLE = 1 << 18


def line(axis: str) -> Window:
    return Window.partitionBy("case_id", *[a for a in AXES if a != axis]).orderBy(axis)


def _l1(df: DataFrame, start: Column, name: str) -> DataFrame:
    out = df.withColumn(name, start.cast("long"))
    for a in AXES:
        w, p = line(a), F.col(a)
        down = F.min(F.col(name) - p).over(w.rowsBetween(Window.unboundedPreceding, 0)) + p
        up = F.min(F.col(name) + p).over(w.rowsBetween(0, Window.unboundedFollowing)) - p
        out = out.withColumn(name, F.least(down, up))
    return out


def whole_cases(df: DataFrame) -> bool:
    """Whether every case of ``df`` is known to fit one block."""
    return most_cells(df) <= WHOLE


def fields(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a column for each name: what its kind (a name in KINDS) makes of a mask or value.

    Cases that fit a block take one shuffle for all of them, others a shuffle for each axis and name.
    """
    if whole_cases(df):
        return _blocks(df, wanted)
    for name, (kind, c) in wanted.items():
        df = KINDS[kind][2](df, c, name)
    return df


def known(df: DataFrame, wanted: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """``fields`` of name to (column, kind, mask or value); a column that ``df`` has already is taken as it is."""
    have = {name: F.col(column) for name, (column, _, _) in wanted.items() if column in df.columns}
    lack = {name: (kind, c) for name, (_, kind, c) in wanted.items() if name not in have}
    df = df.withColumns(have) if have else df
    return fields(df, lack) if lack else df


def l1_distance(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """City-block distance to the mask: ``name <= n`` is n dilations by the cross."""
    return fields(df, {name: ("l1", mask)})


def l1_depth(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """City-block distance to the outside of the mask or grid: ``name > n`` is n erosions."""
    return fields(df, {name: ("l1_depth", mask)})


def opened(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """One erosion, then one dilation."""
    return fields(df, {name: ("opened", mask)})


def edt(df: DataFrame, zero: Column, name: str) -> DataFrame:
    """Exact Euclidean distance (in cells) to the nearest cell where ``zero`` holds; null if a case has none."""
    return fields(df, {name: ("edt", zero)})


def _l1_distance(df: DataFrame, mask: Column, name: str) -> DataFrame:
    return _l1(df, F.when(mask, 0).otherwise(FAR), name)


def _l1_depth(df: DataFrame, mask: Column, name: str) -> DataFrame:
    border = F.least(*[c for a in AXES for c in (F.col(a) + 1, F.col(f"n{a}") - F.col(a))])
    return _l1(df, F.when(mask, border).otherwise(0), name)


def _opened(df: DataFrame, mask: Column, name: str) -> DataFrame:
    out = _l1_depth(df, mask, "__depth")
    out = _l1_distance(out, F.col("__depth") > 1, "__near")
    return out.withColumn(name, F.col("__near") <= 1).drop("__depth", "__near")


def distances(df: DataFrame, zeros: dict[str, Column]) -> DataFrame:
    """``df`` with a distance for each name, to the nearest cell where its condition holds."""
    return fields(df, {n: ("edt", c) for n, c in zeros.items()}) if whole_cases(df) else _distances(df, zeros)


def _distances(df: DataFrame, zeros: dict[str, Column]) -> DataFrame:
    """The first axis is a running minimum.

    On the other two, a line's distances are lowered to the lower envelope of a
    parabola over each of its cells (Felzenszwalb and Huttenlocher 2012), in time
    linear in the line.  Only keys and distances pass through; they join the
    other columns once, by cell.
    """
    keys = ["case_id", *AXES]
    w, x = line("x"), F.col("x")
    cols = {}
    for k, zero in enumerate(zeros.values()):
        down = x - F.last(F.when(zero, x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        up = F.first(F.when(zero, x), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) - x
        d = F.least(down, up)
        cols[f"d{k}"] = F.coalesce(d * d, F.lit(FAR * FAR)).cast("double")
    out = df.select(*keys, *[c.alias(n) for n, c in cols.items()])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for axis in AXES[1:]:
        lines = [c for c in keys if c != axis]
        out = out.repartition(*lines).sortWithinPartitions(*lines).mapInArrow(_lower(axis, list(cols)), kinds)
    found = [F.when(F.col(c) < FAR, F.sqrt(c)).alias(n) for c, n in zip(cols, zeros)]
    return df.drop(*zeros).join(out.select(*keys, *found).hint("merge"), keys)  # compressed sizes would have a whole grid broadcast


def lowest_parabolas(f: np.ndarray) -> np.ndarray:
    """Per row, ``min over p of f[p] + (q - p)^2`` for every q: the envelope of all rows is built together, cell by cell."""
    n, size = f.shape
    rows, k = np.arange(n), np.zeros(n, int)
    v = np.zeros((n, size), int)  # cells whose parabolas form the envelope so far
    z = np.full((n, size + 1), np.inf)  # from where each of them is the lowest
    z[:, 0] = -np.inf
    for q in range(1, size):
        s, open_ = np.empty(n), rows
        while len(open_):
            p = v[open_, k[open_]]
            at = ((f[open_, q] + q * q) - (f[open_, p] + p * p)) / (2.0 * (q - p))
            s[open_] = at
            open_ = open_[at <= z[open_, k[open_]]]
            k[open_] -= 1  # hidden by the new one
        k += 1
        v[rows, k], z[rows, k], z[rows, k + 1] = q, s, np.inf
    out, k = np.empty_like(f), np.zeros(n, int)
    for q in range(size):
        open_ = rows
        while len(open_):
            open_ = open_[z[open_, k[open_] + 1] < q]
            k[open_] += 1
        p = v[rows, k]
        out[:, q] = (q - p) ** 2 + f[rows, p]
    return out


def _lower(axis: str, cols: list[str]):
    lines = ["case_id", *[a for a in AXES if a != axis]]

    def whole(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        case = t.column("case_id").combine_chunks().dictionary_encode().indices.to_numpy()
        code = np.stack([case, *[t.column(c).to_numpy() for c in lines[1:]]])
        row = np.cumsum(np.r_[0, (code[:, 1:] != code[:, :-1]).any(0)]) if t.num_rows else np.zeros(0, int)
        at = t.column(axis).to_numpy()
        for c in cols:
            f = np.full((row[-1] + 1, at.max() + 1), float(FAR) * FAR)
            f[row, at] = t.column(c).to_numpy()
            t = t.set_column(t.schema.get_field_index(c), c, pa.array(lowest_parabolas(f)[row, at]))
        return t.combine_chunks().to_batches()[0]

    return _held(lines, whole)


def _held(keys: list[str], whole: Callable[[pa.Table], pa.RecordBatch]):
    """Rows sorted by ``keys`` in tables of about CELLS rows that hold groups as a whole."""

    def last_group(b: pa.RecordBatch) -> int:
        """Where the last group of a batch begins."""
        end = b.num_rows
        same = np.ones(end, bool)
        for c in keys:
            col = b.column(c)
            same &= np.asarray(pa.compute.equal(col, col[end - 1]).to_numpy(zero_copy_only=False), bool)
        return end - int(np.argmin(same[::-1])) if not same.all() else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = last_group(batch) if sum(b.num_rows for b in held) >= CELLS else 0
            if cut:
                yield whole(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield whole(pa.Table.from_batches(held))

    return run


def signed_distance(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """Positive inside the mask, negative outside."""
    out = distances(df, {"__in": ~mask, "__out": mask})
    return out.withColumn(name, F.col("__in") - F.col("__out")).drop("__in", "__out")


def signed_slope(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """The gradient of the signed distance."""
    return fields(df, {name: ("signed_slope", mask)})


def _signed_slope(df: DataFrame, mask: Column, name: str) -> DataFrame:
    return gradient(signed_distance(df, mask, "__signed"), "__signed", name).drop("__signed")


def gradient(df: DataFrame, value: str, name: str) -> DataFrame:
    """Magnitude of central differences, one-sided at the ends."""
    parts = []
    for a in AXES:
        w, v = line(a), F.col(value)
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        parts.append(F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2))
    return df.withColumn(name, F.sqrt(sum(F.coalesce(p, F.lit(0.0)) * F.coalesce(p, F.lit(0.0)) for p in parts)))


def sobel(df: DataFrame, value: str, name: str) -> DataFrame:
    """Sobel magnitude: a difference along one axis, [1, 2, 1] along the others, edge samples repeated."""
    plain = df.schema[value].dataType.typeName() in ("double", "integer", "long")
    return fields(df, {name: ("sobel", F.col(value))}) if plain else _sobel(df, F.col(value), name)


def _sobel(df: DataFrame, value: Column, name: str) -> DataFrame:
    def pair(col: str, a: str) -> tuple[Column, Column, Column]:
        w, v = line(a), F.col(col)
        return F.coalesce(F.lag(v).over(w), v), v, F.coalesce(F.lead(v).over(w), v)

    out = df.withColumn("__v", value)
    for a in AXES:
        b, _, n = pair("__v", a)
        out = out.withColumn(f"__s{a}", (n - b).cast("double"))
    for a in AXES:  # one sort order serves both smoothings along an axis
        for c in AXES:
            if c != a:
                b, v, n = pair(f"__s{c}", a)
                out = out.withColumn(f"__s{c}", b + 2 * v + n)
    return out.withColumn(name, F.sqrt(sum(F.col(f"__s{a}") * F.col(f"__s{a}") for a in AXES))).drop("__v", *[f"__s{a}" for a in AXES])


# Blocks: arrays of (case, x, y, z) with cases of one shape.


def _swept(d: np.ndarray, axes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """City-block distances lowered along the axes, forth and back."""
    for a in axes:
        p = np.arange(d.shape[a]).reshape([-1 if k == a else 1 for k in range(4)])
        down = np.minimum.accumulate(d - p, a) + p
        up = np.flip(np.minimum.accumulate(np.flip(d + p, a), a), a) - p
        d = np.minimum(down, up)
    return d


def _block_l1(mask: np.ndarray) -> np.ndarray:
    return _swept(np.where(mask, 0, FAR))


def _block_depth(mask: np.ndarray) -> np.ndarray:
    ends = [np.minimum(i + 1, n - i) for n, i in zip(mask.shape[1:], np.indices(mask.shape[1:], sparse=True))]
    return _swept(np.where(mask, np.minimum(np.minimum(ends[0], ends[1]), ends[2]), 0))


def _block_edt(zero: np.ndarray) -> np.ndarray:
    d = _swept(np.where(zero, 0, FAR), (1,))
    f = np.where(d < FAR, d * d, FAR * FAR).astype(float)
    for a in (2, 3):
        lines = np.moveaxis(f, a, -1)
        f = np.moveaxis(lowest_parabolas(lines.reshape(-1, f.shape[a])).reshape(lines.shape), -1, a)
    return np.where(f < FAR, np.sqrt(f), np.nan)


def _sides(v: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells before and after along an axis, edge cells repeated."""
    at = np.arange(v.shape[a])
    return v.take(np.maximum(at - 1, 0), a), v.take(np.minimum(at + 1, len(at) - 1), a)


def _block_slope(mask: np.ndarray) -> np.ndarray:
    v = _block_edt(~mask) - _block_edt(mask)
    out = np.zeros(v.shape)
    for a in (1, 2, 3):
        before, after = _sides(v, a)
        n = v.shape[a]
        ends = (np.arange(n) % max(n - 1, 1) == 0).reshape([-1 if k == a else 1 for k in range(4)])
        p = np.nan_to_num(np.where(ends, after - before, (after - before) / 2))
        out += p * p
    return np.sqrt(out)


def _block_sobel(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    out = np.zeros(v.shape)
    for a in (1, 2, 3):
        before, after = _sides(v, a)
        s = after - before
        for c in (1, 2, 3):
            if c != a:
                before, after = _sides(s, c)
                s = before + 2 * s + after
        out += s * s
    return np.sqrt(out)


#: Kind of a field: its type, what makes it of a block, and of lines.
KINDS: dict[str, tuple[str, Callable[[np.ndarray], np.ndarray], Callable[[DataFrame, Column, str], DataFrame]]] = {
    "l1": ("long", _block_l1, _l1_distance),
    "l1_depth": ("long", _block_depth, _l1_depth),
    "opened": ("boolean", lambda m: _block_l1(_block_depth(m) > 1) <= 1, _opened),
    "edt": ("double", _block_edt, lambda df, c, name: _distances(df, {name: c})),
    "signed_slope": ("double", _block_slope, _signed_slope),
    "sobel": ("double", _block_sobel, _sobel),
}


def _blocks(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """All fields of whole cases, whose rows meet in one task, a few cases at a time."""
    rest = [c for c in df.columns if c not in wanted]
    given = [(c if kind == "sobel" else F.coalesce(c, F.lit(False))).alias(f"__in{k}") for k, (kind, c) in enumerate(wanted.values())]
    out = df.select(*rest, *given)
    made = [(name, kind) for name, (kind, _) in wanted.items()]
    schema = df.select(*rest).schema
    for name, kind in made:
        schema = schema.add(name, KINDS[kind][0])

    def whole(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        case = t.column("case_id").combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.stack([t.column(a).to_numpy() for a in AXES])
        shape = np.stack([t.column(f"n{a}").to_numpy() for a in AXES])
        kinds, which = np.unique(shape, axis=1, return_inverse=True)
        groups = [np.flatnonzero(which.ravel() == k) for k in range(kinds.shape[1])]
        cols = []
        for k, (_, kind) in enumerate(made):
            v = t.column(f"__in{k}").to_numpy()
            found = None
            for size, rows in zip(kinds.T, groups):
                numbers, n = np.unique(case[rows], return_inverse=True)
                block = np.zeros((len(numbers), *size), v.dtype)
                place = (n.ravel(), *at[:, rows])
                block[place] = v[rows]
                got = KINDS[kind][1](block)[place]
                found = np.empty(len(v), got.dtype) if found is None else found
                found[rows] = got
            cols.append(pa.array(found, mask=np.isnan(found) if kind == "edt" else None))
        for k, (name, _) in enumerate(made):
            t = t.drop_columns([f"__in{k}"]).append_column(name, cols[k])
        return t.combine_chunks().to_batches()[0]

    return out.repartition("case_id").sortWithinPartitions("case_id").mapInArrow(_held(["case_id"], whole), schema)
