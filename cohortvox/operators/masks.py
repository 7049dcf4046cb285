"""Region predicates, label remaps, ensembles and percentile masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortvox.sources.voxels import most_cells
from cohortvox.sources.workspace import Workspace

#: Label sets of the regions; both label conventions of enhancing tumour count.
REGIONS = {"background": (0,), "ncr": (1,), "ed": (2,), "et": (3, 4), "tc": (1, 3, 4)}
#: Network-internal label to the published ones of either year.
REMAP_2025 = {1: 2, 2: 1, 3: 3}
REMAP_2021 = {1: 2, 2: 1, 3: 4}
#: Values of a case that one aggregate may hold, and ranges that a larger case's values are counted in.
TOGETHER = 65_536
BUCKETS = 1_024
#: Cases whose thresholds are broadcast, and tasks that share a case's voxels beyond.
BROADCAST_CASES = 100_000
SALTS = 32


def region(name: str, seg: str = "seg") -> Column:
    return F.col(seg) > 0 if name == "wt" else F.col(seg).isin(*REGIONS[name])


def region_names(seg: str = "seg") -> Column:
    """The regions that a voxel lies in."""
    return F.filter(F.array(*[F.when(region(n, seg), F.lit(n)) for n in ("ncr", "ed", "et", "tc", "wt")]), lambda r: r.isNotNull())


def half_even(c: Column) -> Column:
    return F.bround(c).cast("int")


def remap(seg: Column, table: dict[int, int]) -> Column:
    """Labels by table after rounding half to even; others become background."""
    out = F.lit(0)
    for a, b in table.items():
        out = F.when(half_even(seg) == a, b).otherwise(out)
    return out.cast("int")


def remap_check(df: DataFrame, seg: str, table: dict[int, int]) -> DataFrame:
    """Per case, labels before and after a remap and whether they are as the table says."""
    new = remap(F.col(seg).cast("double"), table)
    agg = df.groupBy("case_id").agg(F.array_sort(F.collect_set(seg)).alias("before"), F.array_sort(F.collect_set(new)).alias("after"))
    want = F.array_sort(F.array_distinct(F.transform("before", lambda v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), v), F.lit(0)))))
    top = max(table.values())
    return agg.select(
        "case_id", F.concat_ws(",", F.col("before").cast("array<string>")).alias("before"), F.concat_ws(",", F.col("after").cast("array<string>")).alias("after"),
        (F.col("after") == want).alias("matches"), (~F.array_contains("after", top)).alias("et_missing"),
    )


def ensemble_mean(a: Column, b: Column) -> Column:
    """Two models: the rounded mean, half to even (labels 1 and 3 give 2)."""
    return F.bround((a + b) / 2).cast("int")


def ensemble_mode(votes: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """k models in long form: the most frequent label, the smallest on ties."""
    return votes.groupBy(*keys).agg(F.mode(label, True).alias(label))


def fold_mean(folds: DataFrame, keys: list[str], probability: str = "p") -> DataFrame:
    """Folds in long form: the mean probability of each voxel and region (``keys``)."""
    return folds.groupBy(*keys).agg(F.avg(probability).alias(probability))


def labels_from_probabilities(wt: Column, tc: Column, et: Column, at: float = 0.5) -> Column:
    """Nested region probabilities; a later region in the order wt, tc, et overrides."""
    return F.when(et > at, 3).when(tc > at, 2).when(wt > at, 1).otherwise(0).cast("int")


def suppress_small(df: DataFrame, seg: str, label: int = 3, least: int = 200, into: int = 2) -> DataFrame:
    """Cases with fewer than ``least`` voxels of a label get them relabelled."""
    n = df.groupBy("case_id").agg(F.count_if(F.col(seg) == label).alias("__n"))
    out = df.join(n, "case_id")
    return out.withColumn(seg, F.when((F.col(seg) == label) & (F.col("__n") < least), into).otherwise(F.col(seg)).cast("int")).drop("__n")


def case_percentiles(df: DataFrame, wanted: dict[str, tuple[Column, Column, float]], extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with exact case-level percentiles: name to (value, mask, percent), interpolated between neighbours.

    Thresholds of up to BROADCAST_CASES cases are broadcast, so voxels stay where
    they are; beyond, a case's voxels meet them in SALTS tasks.
    """
    t, cases = percentiles(df, wanted, extra)
    return join_by_case(df, t, cases)


def join_by_case(df: DataFrame, t: DataFrame, cases: int) -> DataFrame:
    """``df`` with a row of ``t`` for each of so many cases."""
    if cases <= BROADCAST_CASES:
        return df.join(F.broadcast(t), "case_id")
    salt = F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALTS))
    spread = t.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return df.withColumn("__salt", salt).join(spread, ["case_id", "__salt"]).drop("__salt")


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, Column, float]], extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """``(table of case_id and percentiles, number of cases)``.

    Cases of at most TOGETHER values take one aggregate, which is written: plans
    that need the thresholds several times do not make them again.  Where the
    table says that its cases are so small they are not counted first.  For larger ones the
    values are counted in BUCKETS ranges between the least and the largest one;
    the ranges that hold the wanted ranks are cut again until they hold at most
    TOGETHER values or a single one, so no task ever holds a case's values.
    """
    if not wanted:
        return df.groupBy("case_id").agg(*[c.alias(n) for n, c in extra.items()]), df.select("case_id").distinct().count()
    value = {n: F.when(m, v).cast("double") for n, (v, m, p) in wanted.items()}
    cases, most = None, most_cells(df)
    if most > TOGETHER:
        size = df.groupBy("case_id").agg(*[F.count(value[n]).alias(n) for n in wanted])
        cases, most = size.agg(F.count("*"), F.max(F.greatest(*wanted, F.lit(0)))).first()
    aggs = [c.alias(n) for n, c in (extra or {}).items()]
    if (most or 0) <= TOGETHER:
        t = df.groupBy("case_id").agg(*[F.percentile(F.when(m, v), p / 100).alias(n) for n, (v, m, p) in wanted.items()], *aggs)
        t = Workspace(df.sparkSession, "percentiles").table(t, "thresholds")
        return t, t.count() if cases is None else cases
    t = df.groupBy("case_id").agg(F.count("*").alias("__n"), *aggs).drop("__n")
    for n, (_, _, p) in wanted.items():
        found = _select(df.select("case_id", "x", "y", "z", value[n].alias("v")).where("v is not null"), p / 100, cases)
        t = t.join(found.withColumnRenamed("p", n), "case_id", "left")
    return t, cases


def _select(values: DataFrame, p: float, cases: int) -> DataFrame:
    """``(case_id, p)`` of (case_id, x, y, z, v) without gathering a case's values."""
    ends = values.groupBy("case_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = (F.col("n") - 1) * F.lit(p)
    ranks = F.array(*[F.struct(F.lit(k).alias("side"), f(at).cast("long").alias("rank")) for k, f in enumerate((F.floor, F.ceil))])
    # One target for either neighbour: its rank among the values from lo to hi.
    ws = Workspace(values.sparkSession, "percentiles")
    targets = ws.table(ends.select("case_id", "n", "lo", "hi", F.explode(ranks).alias("r")).select("case_id", "n", "lo", "hi", "r.side", "r.rank", (at - F.floor(at)).alias("part")), "targets")
    place = lambda lo, hi: F.least(F.floor((F.col("v") - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1))
    while not targets.where(f"n > {TOGETHER} and lo < hi").isEmpty():
        open_ = targets.where(f"n > {TOGETHER} and lo < hi")
        met = join_by_case(values, open_.select("case_id", "side", "lo", "hi"), 2 * cases).where("v between lo and hi")
        counts = met.groupBy("case_id", "side", place(F.col("lo"), F.col("hi")).alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("case_id", "side").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))  # BUCKETS rows a target
        cut = counts.join(open_.select("case_id", "side", "rank", "part"), ["case_id", "side"]).where("rank >= before and rank < before + m")
        cut = cut.select("case_id", F.col("m").alias("n"), "lo", "hi", "side", (F.col("rank") - F.col("before")).alias("rank"), "part")
        done = targets.where(f"n <= {TOGETHER} or lo >= hi")
        targets = ws.table(done.unionByName(cut), "targets")
    met = join_by_case(values, targets.select("case_id", "side", "lo", "hi", "rank", "part").where("lo < hi"), 2 * cases).where("v between lo and hi")
    last = met.groupBy("case_id", "side", "rank", "part").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # TOGETHER values at most
    found = last.select("case_id", "side", "part", F.get("vs", F.col("rank").cast("int")).alias("v")).unionByName(targets.where("lo >= hi").select("case_id", "side", "part", F.col("lo").alias("v")))
    low, high = (F.max(F.when(F.col("side") == k, F.col("v"))) for k in (0, 1))
    return found.groupBy("case_id").agg(low.alias("a"), high.alias("b"), F.max("part").alias("part")).select("case_id", ((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("p"))


def brain_mask(df: DataFrame, seq: str = "t1", name: str = "brain", percent: float = 5) -> DataFrame:
    """``name``: above the percentile of the positive voxels (all positive ones without any); a table that has it keeps it."""
    if name in df.columns:
        return df
    v = F.col(seq)
    t = case_percentiles(df, {"__p": (v, v > 0, percent)})
    return t.withColumn(name, F.coalesce(v > F.col("__p"), v > 0)).drop("__p")


def csf_candidate(df: DataFrame) -> DataFrame:
    """``csf``: positive T1 below the brain's 15th percentile, outside the tumour."""
    t = case_percentiles(df, {"__p": (F.col("t1"), F.col("brain"), 15)})
    return t.withColumn("csf", F.coalesce((F.col("t1") < F.col("__p")) & (F.col("t1") > 0) & (F.col("seg") == 0), F.lit(False))).drop("__p")


def csf_mask(df: DataFrame) -> DataFrame:
    """``csf``: brain that is dark on T1, bright on T2 and dark on FLAIR, outside the tumour."""
    b = F.col("brain")
    t = case_percentiles(df, {"__a": (F.col("t1"), b, 15), "__b": (F.col("t2"), b, 85), "__c": (F.col("flair"), b, 25)})
    m = b & (F.col("t1") < F.col("__a")) & (F.col("t2") > F.col("__b")) & (F.col("flair") < F.col("__c")) & (F.col("seg") == 0)
    return t.withColumn("csf", F.coalesce(m, F.lit(False))).drop("__a", "__b", "__c")


def flow_voids(df: DataFrame) -> DataFrame:
    """``inferior`` brain (lowest third) and ``void``: its darkest T1 outside the tumour."""
    low = F.col("brain") & (F.col("z") < F.floor(F.col("nz") / 3))
    t = case_percentiles(df.withColumn("inferior", low), {"__p": (F.col("t1"), F.col("inferior"), 5)})
    return t.withColumn("void", F.coalesce(F.col("inferior") & (F.col("t1") < F.col("__p")) & (F.col("seg") == 0), F.lit(False))).drop("__p")


def touches_border(margin: int = 3) -> Column:
    out = F.lit(False)
    for a in "xyz":
        out = out | (F.col(a) < margin) | (F.col(a) >= F.col(f"n{a}") - margin)
    return out


def cut(n: str, share: float) -> Column:
    """The grid index at a share of a dimension, truncated."""
    return F.floor(F.col(n) * share)


def lobes() -> dict[str, Column]:
    """Membership in the five boxes of the coarse atlas."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    inside = lambda c, n, a, b: (c >= cut(n, a)) & (c < cut(n, b))
    return {
        "frontal": (y < cut("ny", 0.45)) & (z >= cut("nz", 0.3)),
        "parietal": inside(y, "ny", 0.3, 0.7) & (z >= cut("nz", 0.5)),
        "temporal": ((x < cut("nx", 0.35)) | (x >= cut("nx", 0.65))) & inside(y, "ny", 0.2, 0.7) & (z < cut("nz", 0.55)),
        "occipital": y >= cut("ny", 0.65),
        "deep_structures": inside(x, "nx", 0.3, 0.7) & inside(y, "ny", 0.3, 0.6) & inside(z, "nz", 0.25, 0.6),
    }
