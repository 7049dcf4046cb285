"""Overlap of a predicted with a true labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-8


def scores(tp: Column, fp: Column, fn: Column, tn: Column | None = None) -> list[Column]:
    out = [
        (2 * tp / (2 * tp + fp + fn + EPS)).alias("dice"), (tp / (tp + fp + fn + EPS)).alias("iou"), (tp / (tp + fn + EPS)).alias("sensitivity"),
    ]
    return out + ([(tn / (tn + fp + EPS)).alias("specificity")] if tn is not None else [])


def _counts(p: Column, g: Column) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in (("tp", p & g), ("fp", p & ~g), ("fn", ~p & g), ("tn", ~p & ~g))]


def shape_check(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``(case_id, matches)`` from the geometry of both sides; a case that one side lacks does not match."""
    side = lambda g, n: g.select("case_id", F.struct("nx", "ny", "nz").alias(n))
    return side(pred, "p").join(side(gt, "g"), "case_id", "full").select("case_id", F.coalesce(F.col("p") == F.col("g"), F.lit(False)).alias("matches"))


def paired(pred: DataFrame, gt: DataFrame, pred_geometry: DataFrame, gt_geometry: DataFrame) -> DataFrame:
    """``(case_id, x, y, z, pred, gt)`` for scores: the cells of two label volumes (case_id, x, y, z, label) side by side.

    Cases of unequal shape have no rows, so nothing scores them; a cell that one
    side leaves out is background there.
    """
    ok = shape_check(pred_geometry, gt_geometry).where("matches")
    cells = ["case_id", "x", "y", "z"]
    side = lambda d, n: d.select(*cells, F.col("label").alias(n)).join(ok, "case_id", "left_semi")
    both = side(pred, "pred").join(side(gt, "gt"), cells, "full")
    return both.select(*cells, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pred", "gt")])


def label_scores(df: DataFrame, pred: str, gt: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per label of either side but 0: confusion counts and scores.

    One pass counts (pred, gt) pairs; labels are met with those few rows.
    """
    pairs = df.groupBy(*keys, F.col(pred).alias("p"), F.col(gt).alias("g")).agg(F.count("*").alias("n"))
    labels = pairs.select(*keys, F.explode(F.array("p", "g")).alias("label")).where("label <> 0").distinct()
    j = pairs.join(labels, list(keys)) if keys else pairs.crossJoin(labels)
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    p, g = F.col("p") == F.col("label"), F.col("g") == F.col("label")
    agg = j.groupBy(*keys, "label").agg(hit(p & g).alias("tp"), hit(p & ~g).alias("fp"), hit(~p & g).alias("fn"), hit(~p & ~g).alias("tn"))
    return agg.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


#: Compound regions of the evaluation (label 4 is not among them).
COMPOUNDS = {"WT": (1, 2, 3), "TC": (1, 3), "ET": (3,)}


def compound_scores(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """Per case and compound region (WT, TC, ET): scores without specificity."""
    aggs = []
    for name, labels in COMPOUNDS.items():
        p, g = F.col(pred).isin(*labels), F.col(gt).isin(*labels)
        aggs.append(F.struct(*_counts(p, g)).alias(name))
    wide = df.groupBy("case_id").agg(*aggs)
    long = wide.select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("compound"), F.col(n).alias("c")) for n in COMPOUNDS])).alias("e"))
    long = long.select("case_id", "e.compound", "e.c.tp", "e.c.fp", "e.c.fn")
    return long.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def rating(dice: Column) -> Column:
    return F.when(dice > 0.9, "Excellent").when(dice > 0.8, "Good").when(dice > 0.7, "Moderate").when(dice > 0.5, "Fair").otherwise("Poor")


def pipeline_rating(percent: Column) -> Column:
    return F.when(percent >= 90, "Excellent").when(percent >= 80, "Good").when(percent >= 70, "Moderate").otherwise("Fair")


def mean_dice(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """Per case the mean Dice over WT, TC and ET (0 for a label that neither side has) and its ratings."""
    c = compound_scores(df, pred, gt).groupBy("case_id").agg((F.sum("dice") / len(COMPOUNDS)).alias("mean_dice"))
    return c.select("case_id", "mean_dice", rating(F.col("mean_dice")).alias("rating"), pipeline_rating(F.col("mean_dice") * 100).alias("pipeline_rating"))


def cohort_dice(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """The cohort's mean, best and worst case."""
    m = mean_dice(df, pred, gt)
    return m.agg(
        F.count("*").alias("cases"), F.avg("mean_dice").alias("mean"), F.max("mean_dice").alias("best"),
        F.max_by("case_id", F.struct("mean_dice", -F.col("case_id"))).alias("best_case"), F.min("mean_dice").alias("worst"),
    )


def difference_class(pred: Column, gt: Column) -> Column:
    return (
        F.when((pred == gt) & (gt > 0), "match").when((pred > 0) & (gt > 0), "wrong_class").when(pred > 0, "false_positive")
        .when(gt > 0, "false_negative").otherwise("background")
    )


def label_distribution(df: DataFrame, seg: str) -> DataFrame:
    """Voxels and percent of all voxels per label."""
    from pyspark.sql import Window

    n = df.groupBy("case_id", F.col(seg).alias("label")).agg(F.count("*").alias("voxels"))
    return n.withColumn("percent", 100 * F.col("voxels") / F.sum("voxels").over(Window.partitionBy("case_id")))


def label_audit(df: DataFrame, seg: str, expected: tuple[int, ...] = (0, 1, 2, 4)) -> DataFrame:
    """Labels found, missing and unexpected, and whether 3 stands where 4 is expected."""
    want = F.array(*[F.lit(e) for e in expected])
    found = df.groupBy("case_id").agg(F.array_sort(F.collect_set(F.col(seg).cast("int"))).alias("f"))
    text = lambda c: F.concat_ws(",", c.cast("array<string>"))
    return found.select(
        "case_id", text(F.col("f")).alias("found"), text(F.array_sort(F.array_except(want, "f"))).alias("missing"),
        text(F.array_sort(F.array_except("f", want))).alias("unexpected"), (F.array_contains("f", 3) & ~F.array_contains("f", 4)).alias("three_for_four"),
    )
