"""Registered cohort queries (masks, evaluation, intensity, grid, lesions, anatomy) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.operators import components as C, evaluate as E, grid as G, intensity as I, masks as M, mass_effect as X, morphology as S, quality as Q, slices as L, structures as N
from cohortvox.operators.masks import region
from cohortvox.plans import summary as S2
from cohortvox.sources.voxels import SEQUENCES, VIEW, grid, volumes, voxel_view
from cohortvox.sources.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GRID = f"""v AS ({VIEW}),
g AS (SELECT c.case_id, x.x, y.y, z.z, coalesce(v.t1, 0) AS t1, coalesce(v.t1ce, 0) AS t1ce, coalesce(v.t2, 0) AS t2, coalesce(v.flair, 0) AS flair,
 coalesce(v.seg_gt, 0) AS seg, coalesce(v.seg_pred, 0) AS seg_pred
 FROM (SELECT DISTINCT case_id FROM v) c, range(16) x(x), range(16) y(y), range(12) z(z) LEFT JOIN v ON v.case_id = c.case_id AND v.x = x.x AND v.y = y.y AND v.z = z.z)"""
BRAIN = """b AS (SELECT g.*, g.t1 > p.p5 AS brain FROM g JOIN (SELECT case_id, quantile_cont(t1, 0.05) FILTER (WHERE t1 > 0) AS p5 FROM g GROUP BY 1) p USING (case_id))"""
CM3 = "0.0015"
#: Cell number within a case, as the components use it.
CELL = "(case_id * 4294967296 + (z * 16 + y) * 16 + x)"


def _near(name: str, mask: str, table: str = "g") -> str:
    """Grid cells with their city-block distance d to the mask."""
    return f"""{name} AS (SELECT a.case_id, a.x, a.y, a.z, min(abs(a.x - m.x) + abs(a.y - m.y) + abs(a.z - m.z)) AS d
 FROM {table} a JOIN (SELECT case_id, x, y, z FROM {table} WHERE {mask}) m USING (case_id) GROUP BY ALL)"""


def _depth(name: str, mask: str, table: str = "g") -> str:
    """Mask cells with their city-block distance d to the outside."""
    return f"""{name} AS (SELECT a.case_id, a.x, a.y, a.z, least(min(abs(a.x - m.x) + abs(a.y - m.y) + abs(a.z - m.z)), a.x + 1, 16 - a.x, a.y + 1, 16 - a.y, a.z + 1, 12 - a.z) AS d
 FROM (SELECT * FROM {table} WHERE {mask}) a JOIN (SELECT case_id, x, y, z FROM {table} WHERE NOT ({mask})) m USING (case_id) GROUP BY a.case_id, a.x, a.y, a.z)"""


def _euclid(name: str, zero: str, table: str = "g") -> str:
    return f"""{name} AS (SELECT a.case_id, a.x, a.y, a.z, sqrt(min((a.x - m.x) * (a.x - m.x) + (a.y - m.y) * (a.y - m.y) + (a.z - m.z) * (a.z - m.z))) AS d
 FROM {table} a JOIN (SELECT case_id, x, y, z FROM {table} WHERE {zero}) m USING (case_id) GROUP BY ALL)"""


def _parts(name: str, mask: str, most: int, table: str = "g") -> str:
    """Mask cells with the smallest cell of their component (neighbours differ by 1, in at most ``most`` axes)."""
    return f"""{name}_n AS (SELECT *, {CELL} AS id FROM {table} WHERE {mask}),
{name}_e AS (SELECT a.id AS a, b.id AS b FROM {name}_n a JOIN {name}_n b ON a.case_id = b.case_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1
 WHERE abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) BETWEEN 1 AND {most}),
{name}_c(id, lab) USING KEY (id) AS (SELECT id, id FROM {name}_n UNION
 (SELECT e.a, min(f.lab) FROM {name}_c f JOIN {name}_e e ON e.b = f.id JOIN recurring.{name}_c o ON o.id = e.a WHERE f.lab < o.lab GROUP BY e.a)),
{name} AS (SELECT n.*, c.lab AS component FROM {name}_n n JOIN {name}_c c USING (id))"""


def query(name: str, sql: str | None = None, *ctes: str):
    """Registers a query over the dense grid (or with ``ctes``, its twin over them)."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = "WITH RECURSIVE " + ",\n".join(ctes or (GRID,)) + "\n" + sql
        return run

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


SIGNAL_SQL = ", ".join(f"('{s}', {s})" for s in SEQUENCES)


@query("d01_region_stats", f"""SELECT case_id, region, sequence, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')},
 {r('quantile_cont(v, 0.5)', 'median')}, {r('quantile_cont(v, 0.25)', 'q25')}, {r('quantile_cont(v, 0.75)', 'q75')}, count(*) AS count
FROM (SELECT case_id, unnest(list_filter([CASE WHEN seg = 1 THEN 'ncr' END, CASE WHEN seg = 2 THEN 'ed' END, CASE WHEN seg IN (3, 4) THEN 'et' END, CASE WHEN seg IN (1, 3, 4) THEN 'tc' END, 'wt'], lambda q: q IS NOT NULL)) AS region,
 t1, t1ce, t2, flair FROM g WHERE seg > 0) u, LATERAL (VALUES ('t1', u.t1), ('t1ce', u.t1ce), ('t2', u.t2), ('flair', u.flair)) s(sequence, v) GROUP BY 1, 2, 3""", GRID)
def d01(spark, sf):
    return rounded(I.region_stats(voxel_view(spark, sf)))


@query("b01_region_masks", "SELECT case_id, x, y, z, seg = 0 AS background, seg = 1 AS ncr, seg = 2 AS ed, seg IN (3, 4) AS et, seg IN (1, 3, 4) AS tc, seg > 0 AS wt FROM g")
def b01(spark, sf):
    return grid(spark, sf).select("case_id", "x", "y", "z", *[region(n).alias(n) for n in ("background", "ncr", "ed", "et", "tc", "wt")])


@query("b02_brain_mask", "SELECT case_id, count(*) FILTER (WHERE brain) AS brain_voxels, CAST(sum(CASE WHEN brain THEN x + 16 * y + 256 * z ELSE 0 END) AS BIGINT) AS cells FROM b GROUP BY 1", GRID, BRAIN)
def b02(spark, sf):
    b = M.brain_mask(grid(spark, sf))
    return b.groupBy("case_id").agg(F.count_if("brain").alias("brain_voxels"), F.coalesce(F.sum(F.when(F.col("brain"), F.col("x") + 16 * F.col("y") + 256 * F.col("z"))), F.lit(0)).alias("cells"))


NORMAL = ",\n".join(["n AS (SELECT case_id, " + ", ".join(f"quantile_cont({s}, 0.05) FILTER (WHERE {s} > 0) AS p_{s}" for s in SEQUENCES) + " FROM g GROUP BY 1)",
    "ref AS (SELECT case_id, " + ", ".join(f"avg({s}) FILTER (WHERE {s} > p_{s} AND seg = 0) AS normal_{s}" for s in SEQUENCES) + ", count(*) FILTER (WHERE t1 > p_t1 AND seg = 0) AS voxel_count FROM g JOIN n USING (case_id) GROUP BY 1)"])


@query("b03_normal_reference", "SELECT case_id, " + ", ".join(r(f"normal_{s}", f"normal_{s}") for s in SEQUENCES) + ", voxel_count FROM ref", GRID, NORMAL)
def b03(spark, sf):
    return rounded(I.normal_reference(grid(spark, sf)))


def _remap(name, table):
    case = " ".join(f"WHEN {a} THEN {b}" for a, b in table.items())

    @query(name, f"SELECT case_id, x, y, z, CAST(CASE seg {case} ELSE 0 END AS INT) AS seg FROM g")
    def run(spark, sf):
        return grid(spark, sf).select("case_id", "x", "y", "z", M.remap(F.col("seg").cast("double"), table).alias("seg"))


_remap("b04_remap_2025", M.REMAP_2025)
_remap("b05_remap_2021", M.REMAP_2021)


@query("b06_remap_check", "SELECT case_id, string_agg(DISTINCT CAST(seg AS VARCHAR), ',' ORDER BY CAST(seg AS VARCHAR)) AS before, string_agg(DISTINCT CAST(CASE seg WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 0 END AS VARCHAR), ',' ORDER BY CAST(CASE seg WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 0 END AS VARCHAR)) AS after, true AS matches, max(seg) < 3 AS et_missing FROM g GROUP BY 1")
def b06(spark, sf):
    return M.remap_check(grid(spark, sf), "seg", M.REMAP_2021)


@query("b07_ensemble_mean", "SELECT case_id, x, y, z, CAST(CASE (seg + seg_pred) WHEN 1 THEN 0 WHEN 5 THEN 2 WHEN 3 THEN 2 ELSE (seg + seg_pred) // 2 END AS INT) AS label FROM g")
def b07(spark, sf):
    return grid(spark, sf).select("case_id", "x", "y", "z", M.ensemble_mean(F.col("seg").cast("double"), F.col("seg_pred")).alias("label"))


VOTES = "u AS (SELECT case_id, x, y, z, unnest([seg, seg_pred, CAST(t2 AS BIGINT) % 4]) AS label FROM g)"


@query("b08_ensemble_mode", "SELECT case_id, x, y, z, CAST(label AS INT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY case_id, x, y, z ORDER BY n DESC, label) AS k FROM (SELECT case_id, x, y, z, label, count(*) AS n FROM u GROUP BY ALL)) WHERE k = 1", GRID, VOTES)
def b08(spark, sf):
    third = (F.round("t2").cast("long") % 4).cast("int")
    votes = grid(spark, sf).select("case_id", "x", "y", "z", F.explode(F.array("seg", "seg_pred", third)).alias("label"))
    return M.ensemble_mode(votes, ["case_id", "x", "y", "z"])


PROBS = "p AS (SELECT case_id, x, y, z, (CAST(t1 AS BIGINT) % 10) / 9.0 AS a, (CAST(t1 AS BIGINT) % 7) / 6.0 AS b, (CAST(t2 AS BIGINT) % 5) / 4.0 AS c, seg FROM g)"


@query("b09_fold_probability_average", f"SELECT case_id, seg, {r('avg((a + b) / 2)', 'wt')}, {r('avg((b + c) / 2)', 'tc')} FROM p GROUP BY 1, 2", GRID, PROBS)
def b09(spark, sf):
    p = _probabilities(grid(spark, sf))
    fold = lambda r, v: F.struct(F.lit(r).alias("region"), F.col(v).alias("p"))
    folds = p.select("case_id", "x", "y", "z", "seg", F.explode(F.array(fold("wt", "a"), fold("wt", "b"), fold("tc", "b"), fold("tc", "c"))).alias("f")).select("*", "f.region", "f.p").drop("f")
    means = M.fold_mean(folds, ["case_id", "x", "y", "z", "seg", "region"])
    return rounded(means.groupBy("case_id", "seg").agg(F.avg(F.when(F.col("region") == "wt", F.col("p"))).alias("wt"), F.avg(F.when(F.col("region") == "tc", F.col("p"))).alias("tc")))


def _probabilities(df):
    return df.withColumns({"a": (F.round("t1").cast("long") % 10) / 9, "b": (F.round("t1").cast("long") % 7) / 6, "c": (F.round("t2").cast("long") % 5) / 4})


@query("b10_labels_from_probabilities", "SELECT case_id, x, y, z, CAST(CASE WHEN c > 0.5 THEN 3 WHEN b > 0.5 THEN 2 WHEN a > 0.5 THEN 1 ELSE 0 END AS INT) AS label FROM p", GRID, PROBS)
def b10(spark, sf):
    p = _probabilities(grid(spark, sf))
    return p.select("case_id", "x", "y", "z", M.labels_from_probabilities(F.col("a"), F.col("b"), F.col("c")).alias("label"))


@query("b11_small_class_suppression", "SELECT case_id, CAST(CASE WHEN seg = 3 AND n < 310 THEN 2 ELSE seg END AS INT) AS seg, count(*) AS voxels FROM g JOIN (SELECT case_id, count(*) FILTER (WHERE seg = 3) AS n FROM g GROUP BY 1) USING (case_id) GROUP BY 1, 2")
def b11(spark, sf):
    return M.suppress_small(grid(spark, sf), "seg", least=310).groupBy("case_id", "seg").agg(F.count("*").alias("voxels"))


@query("b12_csf_candidate", "SELECT case_id, count(*) FILTER (WHERE t1 < p AND t1 > 0 AND seg = 0) AS csf FROM b JOIN (SELECT case_id, quantile_cont(t1, 0.15) FILTER (WHERE brain) AS p FROM b GROUP BY 1) USING (case_id) GROUP BY 1", GRID, BRAIN)
def b12(spark, sf):
    return M.csf_candidate(M.brain_mask(grid(spark, sf))).groupBy("case_id").agg(F.count_if("csf").alias("csf"))


CSF = "csf AS (SELECT b.*, brain AND t1 < pa AND t2 > pb AND flair < pc AND seg = 0 AS csf FROM b JOIN (SELECT case_id, quantile_cont(t1, 0.15) FILTER (WHERE brain) AS pa, quantile_cont(t2, 0.85) FILTER (WHERE brain) AS pb, quantile_cont(flair, 0.25) FILTER (WHERE brain) AS pc FROM b GROUP BY 1) USING (case_id))"


@query("b13_csf_mask", "SELECT case_id, count(*) FILTER (WHERE csf) AS csf FROM csf GROUP BY 1", GRID, BRAIN, CSF)
def b13(spark, sf):
    return M.csf_mask(M.brain_mask(grid(spark, sf))).groupBy("case_id").agg(F.count_if("csf").alias("csf"))


@query("b14_flow_voids", "SELECT case_id, count(*) FILTER (WHERE brain AND z < 4) AS inferior, count(*) FILTER (WHERE brain AND z < 4 AND t1 < p AND seg = 0) AS voids FROM b JOIN (SELECT case_id, quantile_cont(t1, 0.05) FILTER (WHERE brain AND z < 4) AS p FROM b GROUP BY 1) USING (case_id) GROUP BY 1", GRID, BRAIN)
def b14(spark, sf):
    return M.flow_voids(M.brain_mask(grid(spark, sf))).groupBy("case_id").agg(F.count_if("inferior").alias("inferior"), F.count_if("void").alias("voids"))


LOBE_SQL = {"frontal": "y < 7 AND z >= 3", "parietal": "y >= 4 AND y < 11 AND z >= 6", "temporal": "(x < 5 OR x >= 10) AND y >= 3 AND y < 11 AND z < 6", "occipital": "y >= 10", "deep_structures": "x >= 4 AND x < 11 AND y >= 4 AND y < 9 AND z >= 3 AND z < 7"}


@query("b15_atlas_boxes", "SELECT case_id, " + ", ".join(f"count(*) FILTER (WHERE seg > 0 AND {c}) AS {k}" for k, c in LOBE_SQL.items()) + " FROM g GROUP BY 1")
def b15(spark, sf):
    return grid(spark, sf).groupBy("case_id").agg(*[F.count_if(region("wt") & c).alias(k) for k, c in M.lobes().items()])


@query("b16_border_touch", "SELECT case_id, bool_or(seg > 0 AND (x < 3 OR x >= 13 OR y < 3 OR y >= 13 OR z < 3 OR z >= 9)) AS at_boundary FROM g GROUP BY 1")
def b16(spark, sf):
    return grid(spark, sf).groupBy("case_id").agg(F.max(region("wt") & M.touches_border()).alias("at_boundary"))


@query("b17_edge_signal", "SELECT case_id, max(t1) FILTER (WHERE x < 5) > 0 AS x_min, max(t1) FILTER (WHERE x >= 11) > 0 AS x_max, max(t1) FILTER (WHERE y < 5) > 0 AS y_min, max(t1) FILTER (WHERE y >= 11) > 0 AS y_max FROM g GROUP BY 1")
def b17(spark, sf):
    return grid(spark, sf).groupBy("case_id").agg(*Q.edge_signal())


@query("b18_stray_enhancement", "SELECT case_id, count(*) FILTER (WHERE seg IN (3, 4) AND NOT seg IN (1, 3, 4)) AS stray, count(*) FILTER (WHERE seg IN (3, 4)) AS et FROM g GROUP BY 1")
def b18(spark, sf):
    return grid(spark, sf).groupBy("case_id").agg(F.count_if(region("et") & ~region("tc")).alias("stray"), F.count_if(region("et")).alias("et"))


@query("b19_best_slice", "SELECT case_id, z, n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, z) AS k FROM (SELECT case_id, z, count(*) AS n FROM g WHERE seg > 0 GROUP BY 1, 2)) WHERE k = 1")
def b19(spark, sf):
    return L.best_slice(grid(spark, sf))


@query("b20_even_slices", "SELECT DISTINCT t.case_id, t.z FROM (SELECT case_id, z, row_number() OVER (PARTITION BY case_id ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY case_id) AS n FROM (SELECT DISTINCT case_id, z FROM g WHERE seg > 0)) t, range(5) i(i) WHERE t.k = CASE WHEN t.n = 1 THEN 0 ELSE floor(i.i * (t.n - 1) / 4.0) END")
def b20(spark, sf):
    return L.even_slices(grid(spark, sf), 5)


@query("b20_middle_slices", "SELECT DISTINCT case_id, CAST(floor(3 + i.i * 6 / 8.0) AS BIGINT) AS z FROM g, range(9) i(i)")
def b20m(spark, sf):
    return L.middle_slices(grid(spark, sf).select("case_id", "nz").distinct())


_BLEND = lambda k: f"avg(CASE WHEN seg IN (1, 2, 4) THEN 0.6 * (t1 - lo) / (hi - lo + 1e-8) + 0.4 * CASE WHEN seg = {k} THEN 1.0 ELSE 0.0 END ELSE (t1 - lo) / (hi - lo + 1e-8) END)"


@query("b21_slice_overlay", f"SELECT case_id, z, seg, {r(_BLEND(1), 'red')}, {r(_BLEND(2), 'green')}, {r(_BLEND(4), 'blue')} FROM (SELECT *, min(t1) OVER (PARTITION BY case_id, z) AS lo, max(t1) OVER (PARTITION BY case_id, z) AS hi FROM g) WHERE seg > 0 GROUP BY 1, 2, 3")
def b21(spark, sf):
    d = L.overlay(grid(spark, sf), "t1").where(region("wt"))
    return rounded(d.groupBy("case_id", "z", "seg").agg(*[F.avg(F.col("rgb")[k]).alias(n) for k, n in enumerate(("red", "green", "blue"))]))


@query("b22_difference_class", "SELECT case_id, CASE WHEN seg = seg_pred AND seg > 0 THEN 'match' WHEN seg_pred > 0 AND seg > 0 THEN 'wrong_class' WHEN seg_pred > 0 THEN 'false_positive' WHEN seg > 0 THEN 'false_negative' ELSE 'background' END AS class, count(*) AS voxels FROM g GROUP BY 1, 2")
def b22(spark, sf):
    return grid(spark, sf).groupBy("case_id", E.difference_class(F.col("seg_pred"), F.col("seg")).alias("class")).agg(F.count("*").alias("voxels"))


@query("b23_label_colours", "SELECT case_id, CASE seg WHEN 1 THEN '255,0,0' WHEN 2 THEN '0,255,0' WHEN 3 THEN '0,0,255' WHEN 4 THEN '255,255,0' ELSE '0,0,0' END AS colour, count(*) AS voxels FROM g GROUP BY 1, 2")
def b23(spark, sf):
    return grid(spark, sf).groupBy("case_id", F.concat_ws(",", L.colour(F.col("seg")).cast("array<string>")).alias("colour")).agg(F.count("*").alias("voxels"))


@query("d03_volumes", "SELECT case_id, " + ", ".join(r(f"count(*) FILTER (WHERE {c}) * {CM3}", f"{k}_cm3") for k, c in (("wt", "seg > 0"), ("tc", "seg IN (1, 3, 4)"), ("et", "seg IN (3, 4)"), ("ncr", "seg = 1"), ("ed", "seg = 2"))) + " FROM g GROUP BY 1")
def d03(spark, sf):
    return rounded(I.volumes_cm3(grid(spark, sf)))


@query("d08_label_volumes", f"SELECT case_id, seg AS label, count(*) AS voxels, {r(f'count(*) * {CM3}', 'cm3')} FROM g WHERE seg > 0 GROUP BY 1, 2")
def d08(spark, sf):
    return rounded(I.label_volumes(grid(spark, sf)))


@query("c02_shape_check", "SELECT DISTINCT case_id, case_id % 3 <> 0 AS matches FROM v")
def c02(spark, sf):
    """Every third case of the predicted side has another depth, and one side lacks every sixth."""
    v = voxel_view(spark, sf)
    gt, k = volumes(v), F.col("case_id")
    pred = gt.withColumn("nz", F.when(k % 3 == 0, F.col("nz") + 1).otherwise(F.col("nz"))).where(k % 6 != 0)
    return E.shape_check(pred, gt)


@query("d04_d05_extent", "SELECT case_id, " + ", ".join(f"{r(f'avg({a})', f'c{a}')}, min({a}) AS {a}_min, max({a}) AS {a}_max, max({a}) - min({a}) + 1 AS {a}_size" for a in "xyz") + " FROM g WHERE seg > 0 GROUP BY 1")
def d04(spark, sf):
    return rounded(I.extent(grid(spark, sf), region("wt")))


@query("d06_label_distribution", f"SELECT case_id, seg AS label, count(*) AS voxels, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY case_id)', 'percent')} FROM g GROUP BY 1, 2")
def d06(spark, sf):
    return rounded(E.label_distribution(grid(spark, sf), "seg"))


@query("d07_label_audit", "SELECT case_id, string_agg(DISTINCT CAST(seg AS VARCHAR), ',' ORDER BY CAST(seg AS VARCHAR)) AS found, concat_ws(',', CASE WHEN NOT bool_or(seg = 0) THEN '0' END, CASE WHEN NOT bool_or(seg = 1) THEN '1' END, CASE WHEN NOT bool_or(seg = 2) THEN '2' END, '4') AS missing, CASE WHEN bool_or(seg = 3) THEN '3' ELSE '' END AS unexpected, bool_or(seg = 3) AS three_for_four FROM g GROUP BY 1")
def d07(spark, sf):
    return E.label_audit(grid(spark, sf), "seg")


def _dice(tp="tp", fp="fp", fn="fn"):
    return f"{r(f'2.0 * {tp} / (2 * {tp} + {fp} + {fn} + 1e-8)', 'dice')}, {r(f'{tp} / ({tp} + {fp} + {fn} + 1e-8)', 'iou')}, {r(f'{tp} / ({tp} + {fn} + 1e-8)', 'sensitivity')}"


PAIRS = "l AS (SELECT k.case_id, label, count(*) FILTER (WHERE seg_pred = label AND seg = label) AS tp, count(*) FILTER (WHERE seg_pred = label AND seg <> label) AS fp, count(*) FILTER (WHERE seg_pred <> label AND seg = label) AS fn, count(*) FILTER (WHERE seg_pred <> label AND seg <> label) AS tn FROM g JOIN (SELECT DISTINCT case_id, unnest([seg, seg_pred]) AS label FROM g) k ON g.case_id = k.case_id WHERE label <> 0 GROUP BY 1, 2)"


@query("d09_confusion_dice", f"SELECT case_id, label, tp, fp, fn, tn, {_dice()}, {r('tn / (tn + fp + 1e-8)', 'specificity')} FROM l", GRID, PAIRS)
def d09(spark, sf):
    return rounded(E.label_scores(grid(spark, sf), "seg_pred", "seg"))


@query("d09_label_table_scores", f"SELECT label, tp, fp, fn, tn, {_dice()}, {r('tn / (tn + fp + 1e-8)', 'specificity')} FROM (SELECT 1 AS label, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fp, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fn, count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS tn FROM labels)", "one AS (SELECT 1)")
def d09b(spark, sf):
    return rounded(E.label_scores(spark.read.parquet(f"{sf}/labels.parquet"), "toxic", "quality", keys=()))


COMP = "w AS (SELECT case_id, c.compound, " + ", ".join(f"count(*) FILTER (WHERE {p}list_contains(c.s, seg_pred) AND {q}list_contains(c.s, seg)) AS {n}" for n, p, q in (("tp", "", ""), ("fp", "", "NOT "), ("fn", "NOT ", ""))) + " FROM g, (VALUES ('WT', [1, 2, 3]), ('TC', [1, 3]), ('ET', [3])) c(compound, s) GROUP BY 1, 2)"


@query("d10_compound_dice", f"SELECT case_id, compound, tp, fp, fn, {_dice()} FROM w", GRID, COMP)
def d10(spark, sf):
    return rounded(E.compound_scores(grid(spark, sf), "seg_pred", "seg"))


MEAN = "m AS (SELECT case_id, sum(2.0 * tp / (2 * tp + fp + fn + 1e-8)) / 3 AS mean_dice FROM w GROUP BY 1)"


@query("d11_d12_mean_dice_rating", f"SELECT case_id, {r('mean_dice', 'mean_dice')}, CASE WHEN mean_dice > 0.9 THEN 'Excellent' WHEN mean_dice > 0.8 THEN 'Good' WHEN mean_dice > 0.7 THEN 'Moderate' WHEN mean_dice > 0.5 THEN 'Fair' ELSE 'Poor' END AS rating, CASE WHEN mean_dice >= 0.9 THEN 'Excellent' WHEN mean_dice >= 0.8 THEN 'Good' WHEN mean_dice >= 0.7 THEN 'Moderate' ELSE 'Fair' END AS pipeline_rating FROM m", GRID, COMP, MEAN)
def d11(spark, sf):
    return rounded(E.mean_dice(grid(spark, sf), "seg_pred", "seg"))


@query("d13_cohort_dice", f"SELECT count(*) AS cases, {r('avg(mean_dice)', 'mean')}, {r('max(mean_dice)', 'best')}, (SELECT case_id FROM m ORDER BY mean_dice DESC, case_id LIMIT 1) AS best_case, {r('min(mean_dice)', 'worst')} FROM m", GRID, COMP, MEAN)
def d13(spark, sf):
    return rounded(E.cohort_dice(grid(spark, sf), "seg_pred", "seg"))


def _label(x):
    return f"CASE WHEN {x} < 0.6 THEN 'markedly hypointense' WHEN {x} < 0.85 THEN 'hypointense' WHEN {x} < 1.15 THEN 'isointense' WHEN {x} < 1.5 THEN 'hyperintense' ELSE 'markedly hyperintense' END"


SIGNALS = "sig AS (SELECT q.*, " + ", ".join(f"{s}_mean / normal_{s} AS {s}_r" for s in SEQUENCES) + " FROM (SELECT case_id, CASE seg WHEN 1 THEN 'ncr' WHEN 2 THEN 'ed' ELSE 'et' END AS region, count(*) AS voxels, stddev_pop(t1ce) AS t1ce_std, " + ", ".join(f"avg({s}) AS {s}_mean" for s in SEQUENCES) + " FROM g WHERE seg > 0 GROUP BY 1, 2) q JOIN ref USING (case_id))"


@query("e01_e04_region_signals", "SELECT case_id, region, voxels, " + ", ".join(f"round({s}_r, 3) AS {s}_ratio, {_label(f'{s}_r')} AS {s}_label" for s in SEQUENCES) + f", round(t1ce_mean / t1_mean, 3) AS enhancement_ratio, 'T1 ' || {_label('t1_r')} || ', T2 ' || {_label('t2_r')} || ', FLAIR ' || {_label('flair_r')} || ', T1ce ' || {_label('t1ce_r')} AS signal_summary FROM sig", GRID, NORMAL, SIGNALS)
def e01(spark, sf):
    s = I.region_signals(grid(spark, sf))
    cols = [c for q in SEQUENCES for c in (f"{q}_ratio", f"{q}_label")]
    return s.select("case_id", "region", "voxels", *cols, "enhancement_ratio", "signal_summary")


RING = "ring AS (SELECT g.case_id, count(*) FILTER (WHERE seg IN (3, 4)) AS et, count(*) FILTER (WHERE seg = 1) AS ncr, count(*) FILTER (WHERE seg IN (3, 4) AND nn.d <= 2) AS rim FROM g LEFT JOIN nn USING (case_id, x, y, z) GROUP BY 1)"


def ring(df: DataFrame) -> DataFrame:
    d = G.l1_distance(df, region("ncr"), "near")
    return d.groupBy("case_id").agg(F.count_if(region("et")).alias("et"), F.count_if(region("ncr")).alias("ncr"), F.count_if(region("et") & (F.col("near") <= 2)).alias("rim"))


@query("e05_enhancement", """SELECT case_id, et > 0 AS present, CASE WHEN et = 0 THEN 'Non-enhancing' WHEN ncr > 0 AND rim > 0.3 * et THEN 'Ring-enhancing' ELSE 'Solid/nodular enhancing' END AS pattern,
 CASE WHEN et = 0 THEN 'Not applicable' WHEN t1ce_std / t1ce_mean > 0.35 THEN 'Markedly heterogeneous' WHEN t1ce_std / t1ce_mean > 0.25 THEN 'Heterogeneous' WHEN t1ce_std / t1ce_mean > 0.15 THEN 'Mildly heterogeneous' WHEN t1ce_mean > 0 THEN 'Homogeneous' END AS heterogeneity,
 CASE WHEN et = 0 THEN NULL WHEN round(t1ce_mean / t1_mean, 3) > 2 THEN 'Marked enhancement' WHEN round(t1ce_mean / t1_mean, 3) > 1.5 THEN 'Strong enhancement' WHEN round(t1ce_mean / t1_mean, 3) > 1.2 THEN 'Moderate enhancement' WHEN round(t1ce_mean / t1_mean, 3) > 1.05 THEN 'Mild enhancement' ELSE 'Minimal/equivocal enhancement' END AS strength
FROM ring LEFT JOIN (SELECT * FROM sig WHERE region = 'et') USING (case_id)""", GRID, NORMAL, SIGNALS, _near("nn", "seg = 1"), RING)
def e05(spark, sf):
    g = grid(spark, sf)
    return I.enhancement(I.region_signals(g), ring(g))


@query("e06_t2_flair_mismatch", "SELECT case_id, bool_or(round(t2_r, 3) > 1.3 AND round(flair_r, 3) < 0.7 * round(t2_r, 3)) AS mismatch, min_by(region, CASE region WHEN 'ncr' THEN 0 WHEN 'ed' THEN 1 ELSE 2 END) FILTER (WHERE round(t2_r, 3) > 1.3 AND round(flair_r, 3) < 0.7 * round(t2_r, 3)) AS region FROM sig GROUP BY 1", GRID, NORMAL, SIGNALS)
def e06(spark, sf):
    return I.t2_flair_mismatch(I.region_signals(grid(spark, sf)))


@query("g01_l1_dilation", "SELECT case_id, x, y, z, d FROM nn", GRID, _near("nn", "seg = 3"))
def g01(spark, sf):
    return G.l1_distance(grid(spark, sf), region("et"), "d").select("case_id", "x", "y", "z", "d")


@query("g02_erosion_depth", "SELECT g.case_id, g.x, g.y, g.z, coalesce(d, 0) AS d FROM g LEFT JOIN dp USING (case_id, x, y, z)", GRID, _depth("dp", "seg > 0"))
def g02(spark, sf):
    return G.l1_depth(grid(spark, sf), region("wt"), "d").select("case_id", "x", "y", "z", "d")


OPEN = "od AS (SELECT g.*, coalesce(dp.d, 0) > 1 AS core FROM g LEFT JOIN dp USING (case_id, x, y, z))"


@query("g03_opening", "SELECT case_id, x, y, z, d <= 1 AS opened FROM nn", GRID, _depth("dp", "seg > 0"), OPEN, _near("nn", "core", "od"))
def g03(spark, sf):
    return G.opened(grid(spark, sf), region("wt"), "opened").select("case_id", "x", "y", "z", "opened")


@query("g04_shells", "SELECT g.case_id, count(*) FILTER (WHERE dp.d <= 1) AS surface, count(*) FILTER (WHERE nn.d = 1) AS outer_shell, count(*) FILTER (WHERE nn.d BETWEEN 1 AND 5) AS band FROM g LEFT JOIN dp USING (case_id, x, y, z) JOIN nn USING (case_id, x, y, z) GROUP BY 1", GRID, _depth("dp", "seg > 0"), _near("nn", "seg > 0"))
def g04(spark, sf):
    d = G.l1_distance(G.l1_depth(grid(spark, sf), region("wt"), "depth"), region("wt"), "near")
    return d.groupBy("case_id").agg(F.count_if(region("wt") & (F.col("depth") <= 1)).alias("surface"), F.count_if(F.col("near") == 1).alias("outer_shell"), F.count_if(F.col("near").between(1, 5)).alias("band"))


@query("g05_euclidean_distance", f"SELECT case_id, x, y, z, {r('d', 'd')} FROM eu", GRID, _euclid("eu", "seg = 0"))
def g05(spark, sf):
    return rounded(G.edt(grid(spark, sf), ~region("wt"), "d").select("case_id", "x", "y", "z", "d"))


SIGNED = "sd AS (SELECT g.*, a.d - b.d AS s FROM g JOIN ea a USING (case_id, x, y, z) JOIN eb b USING (case_id, x, y, z))"


@query("g06_signed_distance", f"SELECT case_id, x, y, z, {r('s', 's')} FROM sd", GRID, _euclid("ea", "seg = 0"), _euclid("eb", "seg > 0"), SIGNED)
def g06(spark, sf):
    return rounded(G.signed_distance(grid(spark, sf), region("wt"), "s").select("case_id", "x", "y", "z", "s"))


def _grad(name, value, table):
    part = lambda a: f"CASE WHEN lag({value}) OVER w{a} IS NULL THEN lead({value}) OVER w{a} - {value} WHEN lead({value}) OVER w{a} IS NULL THEN {value} - lag({value}) OVER w{a} ELSE (lead({value}) OVER w{a} - lag({value}) OVER w{a}) / 2.0 END"
    windows = ", ".join(f"w{a} AS (PARTITION BY case_id, {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a})" for a in "xyz")
    return f"{name} AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS grad FROM (SELECT *, {', '.join(f'{part(a)} AS g{a}' for a in 'xyz')} FROM {table} WINDOW {windows}))"


@query("g07_gradient", f"SELECT case_id, x, y, z, {r('grad', 'grad')} FROM gr", GRID, _grad("gr", "t1", "g"))
def g07(spark, sf):
    return rounded(G.gradient(grid(spark, sf), "t1", "grad").select("case_id", "x", "y", "z", "grad"))


def _smooth(table, out, axis, plans):
    lag, lead = (f"coalesce({f}({{0}}) OVER w, {{0}})" for f in ("lag", "lead"))
    cols = ", ".join((f"{lead} - {lag}" if kind == "d" else f"{lag} + 2 * {{0}} + {lead}").format(src) + f" AS {dst}" for src, dst, kind in plans)
    return f"{out} AS (SELECT case_id, x, y, z, seg, t1, {cols} FROM {table} WINDOW w AS (PARTITION BY case_id, {', '.join(b for b in 'xyz' if b != axis)} ORDER BY {axis}))"


SOBEL = ",\n".join([
    _smooth("g", "s1", "x", [("t1", "ax", "d"), ("t1", "ay", "s"), ("t1", "az", "s")]), _smooth("s1", "s2", "y", [("ax", "px", "s"), ("ay", "py", "d"), ("az", "pz", "s")]),
    _smooth("s2", "s3", "z", [("px", "cx", "s"), ("py", "cy", "s"), ("pz", "cz", "d")]), "so AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS grad FROM s3)",
])


@query("g08_sobel", f"SELECT case_id, x, y, z, {r('grad', 'grad')} FROM so", GRID, SOBEL)
def g08(spark, sf):
    return rounded(G.sobel(grid(spark, sf), "t1", "grad").select("case_id", "x", "y", "z", "grad"))


def _components(name, kind, most):
    @query(name, "SELECT case_id, x, y, z, component FROM cc", GRID, _parts("cc", "seg > 0", most))
    def run(spark, sf):
        return C.label(grid(spark, sf), region("wt"), Workspace(spark, name), kind).select("case_id", "x", "y", "z", "component")


_components("g09_components_26", 26, 3)
_components("g09_components_18", 18, 2)
_components("g09_components_6", 6, 1)


@query("g10_hole_fraction", f"""SELECT n.case_id, coalesce(h, 0) AS hole_voxels, {r('coalesce(h, 0) / n', 'hole_fraction')} FROM (SELECT case_id, count(*) AS n FROM g WHERE seg > 0 GROUP BY 1) n
 LEFT JOIN (SELECT case_id, count(*) AS h FROM bg WHERE component NOT IN (SELECT component FROM bg WHERE x IN (0, 15) OR y IN (0, 15) OR z IN (0, 11)) GROUP BY 1) USING (case_id)""", GRID, _parts("bg", "seg = 0", 1))
def g10(spark, sf):
    return rounded(C.hole_fraction(grid(spark, sf), region("wt"), Workspace(spark, "g10")))


@query("g11_large_central_components", "SELECT case_id, component, count(*) AS voxels FROM cc GROUP BY 1, 2 HAVING count(*) > 100 AND abs(avg(x) - 8) < 0.3 * 16", GRID, _parts("cc", "seg > 0", 3))
def g11(spark, sf):
    g = grid(spark, sf)
    s = C.component_stats(C.label(g, region("wt"), Workspace(spark, "g11")))
    return C.central_large(s, g.select("case_id", "nx").distinct(), 100).select("case_id", "component", "voxels")


STATS = """st AS (SELECT case_id, component, count(*) AS voxels, count(*) * 0.0015 AS volume_cm3, avg(x) AS mx, avg(y) AS my, avg(z) * 1.5 AS mz,
 greatest(max(x) - min(x), max(y) - min(y), (max(z) - min(z)) * 1.5) + 0.0 AS max_diameter_mm, count(*) FILTER (WHERE seg = 1) AS ncr, count(*) FILTER (WHERE seg = 2) AS ed, count(*) FILTER (WHERE seg = 3) AS et, min((x * 16 + y) * 12 + z) AS scan FROM cc GROUP BY 1, 2),
le AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY volume_cm3 DESC, scan) AS rank FROM st WHERE volume_cm3 >= {least})"""


@query("e12_d18_lesions", f"SELECT case_id, component, voxels, {r('volume_cm3', 'volume_cm3')}, {r('mx', 'mx')}, {r('my', 'my')}, {r('mz', 'mz')}, max_diameter_mm, ncr, ed, et, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 'Primary lesion' ELSE 'Secondary lesion #' || (rank - 1) END AS classification FROM le", GRID, _parts("cc", "seg > 0", 3), STATS.format(least=0.003))
def e12(spark, sf):
    out = C.lesions(C.component_stats(C.label(grid(spark, sf), region("wt"), Workspace(spark, "e12"))), 0.003)
    return rounded(out.select("case_id", "component", "voxels", "volume_cm3", "mx", "my", "mz", "max_diameter_mm", "ncr", "ed", "et", "rank", "classification"))


DIST = "sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz))"


@query("e13_e14_lesion_distances", f"SELECT a.case_id, CAST(a.rank AS INT) AS rank1, CAST(b.rank AS INT) AS rank2, {r(DIST, 'distance_mm')}, CASE WHEN {DIST} < 20 THEN 'Satellite/adjacent' WHEN {DIST} < 40 THEN 'Regional spread' ELSE 'Distant/separate' END AS relationship FROM le a JOIN le b ON a.case_id = b.case_id AND a.rank < b.rank", GRID, _parts("cc", "seg > 0", 3), STATS.format(least=0.0))
def e13(spark, sf):
    ranked = C.lesions(C.component_stats(C.label(grid(spark, sf), region("wt"), Workspace(spark, "e13"))), 0.0)
    return rounded(C.lesion_pairs(ranked).select("case_id", "rank1", "rank2", "distance_mm", "relationship"))


PAIR_STATS = f"pr AS (SELECT a.case_id, min({DIST}) AS mn, max({DIST}) AS mx, avg({DIST}) AS me, count(*) FILTER (WHERE a.rank = 1 AND {DIST} < 20) AS sat FROM le a JOIN le b ON a.case_id = b.case_id AND a.rank < b.rank GROUP BY 1)"


def _multiplicity(name, least):
    @query(name, f"""SELECT case_id, n AS lesions, fr AS fragments, {r('mn', 'min_mm')}, {r('mx', 'max_mm')}, {r('me', 'mean_mm')}, sat AS satellites, fo AS foci, {r('ev', 'enhancing_cm3')},
 CASE WHEN n = 0 THEN 'No tumor' WHEN n = 1 THEN 'Solitary' WHEN sat > 0 THEN 'Primary with satellites' WHEN n <= 3 AND mx > 0 AND mx < 40 THEN 'Regional multifocal' WHEN n <= 3 THEN 'Distant multifocal' ELSE 'Diffuse/scattered' END AS pattern,
 CASE WHEN fo = 0 THEN 'Non-enhancing' WHEN fo = 1 THEN 'Single enhancing focus' WHEN fo <= 3 THEN 'Few enhancing foci' ELSE 'Multiple/scattered enhancing foci' END AS foci_pattern,
 CASE WHEN n = 0 THEN NULL WHEN fo = 0 THEN 'Non-enhancing pattern may suggest low-grade pathology' WHEN fo > n THEN 'Multiple enhancing foci within lesions suggest heterogeneous enhancement' ELSE 'Enhancement pattern consistent with lesion count' END AS enhancement_note
FROM (SELECT case_id, coalesce(n, 0) AS n, coalesce(fr, 0) AS fr, mn, mx, me, coalesce(sat, 0) AS sat, coalesce(fo, 0) AS fo, coalesce(ev, 0) AS ev FROM (SELECT DISTINCT case_id FROM g) k
 LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE volume_cm3 >= {least}) AS n, count(*) FILTER (WHERE volume_cm3 < {least}) AS fr FROM st GROUP BY 1) USING (case_id)
 LEFT JOIN pr USING (case_id) LEFT JOIN (SELECT case_id, count(DISTINCT component) AS fo, count(*) * 0.0015 AS ev FROM ec GROUP BY 1) USING (case_id))""", GRID, _parts("cc", "seg > 0", 3), STATS.format(least=least), PAIR_STATS, _parts("ec", "seg = 3", 3))
    def run(spark, sf):
        g, ws = grid(spark, sf), Workspace(spark, name)
        return rounded(C.multiplicity(g, C.component_stats(C.label(g, region("wt"), ws)), C.component_stats(C.label(g, F.col("seg") == 3, ws)), least))


_multiplicity("e12_e17_multiplicity", 0.1)
#: Small lesions, so that the patterns of several lesions occur in the derived grids.
_multiplicity("e12_e17_small_lesions", 0.0045)


SHIFT = """sh AS (SELECT case_id, mid, tx, coalesce(((l - (mid - w)) + (rr - (mid + w))) / 2, 0) AS est FROM
 (SELECT case_id, (min(x) FILTER (WHERE brain) + max(x) FILTER (WHERE brain)) / 2.0 AS mid, (max(x) FILTER (WHERE brain) - min(x) FILTER (WHERE brain)) / 4.0 AS w, avg(x) FILTER (WHERE seg > 0) AS tx FROM b GROUP BY 1)
 JOIN (SELECT b.case_id, avg(x) FILTER (WHERE x < floor(m.mid)) AS l, avg(x) FILTER (WHERE x >= floor(m.mid)) AS rr FROM b JOIN (SELECT case_id, (min(x) FILTER (WHERE brain) + max(x) FILTER (WHERE brain)) / 2.0 AS mid FROM b GROUP BY 1) m USING (case_id) WHERE brain GROUP BY 1) USING (case_id))"""


@query("e07_midline_shift", f"SELECT case_id, {r('abs(est)', 'shift_mm')}, CASE WHEN abs(est) < 1 THEN 'Not applicable (below measurement threshold)' WHEN (est > 0) = (tx < mid) THEN 'Left to right' ELSE 'Right to left' END AS direction, CASE WHEN tx < mid THEN 'left' ELSE 'right' END AS tumor_hemisphere, CASE WHEN abs(est) < 1 THEN 'None' WHEN abs(est) < 3 THEN 'Minimal' WHEN abs(est) < 5 THEN 'Mild' WHEN abs(est) < 10 THEN 'Moderate' ELSE 'Severe' END AS severity, abs(est) >= 1 AS significant, {r('abs(tx - mid)', 'distance_to_midline_mm')} FROM sh", GRID, BRAIN, SHIFT)
def e07(spark, sf):
    return rounded(X.midline_shift(grid(spark, sf)))


CAND = "cd AS (SELECT b.*, t1 < p AND t1 > 0 AND seg = 0 AS csf FROM b JOIN (SELECT case_id, quantile_cont(t1, 0.15) FILTER (WHERE brain) AS p FROM b GROUP BY 1) USING (case_id))"
VENT = "ve AS (SELECT cd.case_id, count(*) FILTER (WHERE csf AND x < 8) * 0.0015 AS lo, count(*) FILTER (WHERE csf AND x >= 8) * 0.0015 AS hi, min(d) FILTER (WHERE seg > 0) AS mm FROM cd JOIN eu USING (case_id, x, y, z) GROUP BY 1)"


@query("e08_ventricular_compression", f"SELECT case_id, {r('lo', 'left_cm3')}, {r('hi', 'right_cm3')}, {r('mm', 'distance_mm')}, {r('abs(lo - hi) / (lo + hi)', 'asymmetry')}, CASE WHEN lo < 0.7 * hi THEN 'left' WHEN hi < 0.7 * lo THEN 'right' ELSE 'none' END AS compressed_side, CASE WHEN abs(lo - hi) / (lo + hi) > 0.5 THEN 'Severe' WHEN abs(lo - hi) / (lo + hi) > 0.3 THEN 'Moderate' WHEN abs(lo - hi) / (lo + hi) > 0.15 THEN 'Mild' ELSE 'None/Minimal' END AS severity FROM ve", GRID, BRAIN, CAND, _euclid("eu", "csf", "cd"), VENT)
def e08(spark, sf):
    return rounded(X.ventricular_compression(grid(spark, sf)))


SULCI = "su AS (SELECT b.case_id, count(*) FILTER (WHERE brain AND d BETWEEN 1 AND 10) AS nr, count(*) FILTER (WHERE brain AND d > 10) AS nf, stddev_pop(t1) FILTER (WHERE brain AND d BETWEEN 1 AND 10) / stddev_pop(t1) FILTER (WHERE brain AND d > 10) AS q, stddev_pop(t1) FILTER (WHERE brain AND d > 10) AS fs FROM b JOIN nn USING (case_id, x, y, z) GROUP BY 1)"


@query("e09_sulcal_effacement", f"SELECT case_id, CASE WHEN nf > 0 THEN round(CASE WHEN fs > 0 THEN q ELSE 1 END, 6) END AS variance_ratio, CASE WHEN nf = 0 THEN 'Severe' WHEN fs > 0 AND q < 0.6 THEN 'Moderate to Severe' WHEN fs > 0 AND q < 0.8 THEN 'Mild to Moderate' ELSE 'None/Minimal' END AS severity, nf = 0 OR (fs > 0 AND q < 0.8) AS effacement FROM su", GRID, BRAIN, _near("nn", "seg > 0"), SULCI)
def e09(spark, sf):
    return rounded(X.sulcal_effacement(grid(spark, sf)))


def mass_effect(spark, sf):
    g = grid(spark, sf)
    return X.herniation(X.midline_shift(g), X.ventricular_compression(g), X.sulcal_effacement(g), I.volumes_cm3(g))


POINTS = "pt AS (SELECT case_id, abs(est) AS mm, abs(lo - hi) / (lo + hi) AS a, CASE WHEN nf = 0 OR (fs > 0 AND q < 0.6) THEN 1.0 WHEN fs > 0 AND q < 0.8 THEN 0.5 ELSE 0.0 END AS s FROM sh JOIN ve USING (case_id) JOIN su USING (case_id)), sc AS (SELECT *, CASE WHEN mm >= 10 THEN 4.0 WHEN mm >= 5 THEN 3.0 WHEN mm >= 3 THEN 2.0 WHEN mm >= 1 THEN 1.0 ELSE 0.0 END + CASE WHEN a > 0.5 THEN 2.0 WHEN a > 0.3 THEN 1.0 WHEN a > 0.15 THEN 0.5 ELSE 0.0 END + s AS score FROM pt)"


@query("e10_herniation", "SELECT case_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 5 THEN 'High' WHEN score >= 3 THEN 'Moderate' WHEN score >= 1.5 THEN 'Mild' ELSE 'Low' END AS risk FROM sc", GRID, BRAIN, SHIFT, CAND, _euclid("eu", "csf", "cd"), VENT, _near("nn", "seg > 0"), SULCI, POINTS)
def e10(spark, sf):
    return mass_effect(spark, sf).select("case_id", "score", "risk")


@query("e10_herniation_report", """SELECT case_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 5 THEN 'High' WHEN score >= 3 THEN 'Moderate' WHEN score >= 1.5 THEN 'Mild' ELSE 'Low' END AS risk,
 concat_ws('; ', CASE WHEN mm >= 1 THEN 'Midline shift: ' || printf('%.1f', mm) || 'mm (' || CASE WHEN mm >= 10 THEN 'severe' WHEN mm >= 5 THEN 'moderate' WHEN mm >= 3 THEN 'mild' ELSE 'minimal' END || ')' END,
  CASE WHEN a > 0.15 THEN 'Ventricular asymmetry: ' || printf('%.2f', a) || ' (' || CASE WHEN a > 0.5 THEN 'severe' WHEN a > 0.3 THEN 'moderate' ELSE 'mild' END || ')' END,
  CASE WHEN s = 1 THEN 'Sulcal effacement: ' || word WHEN s = 0.5 THEN 'Sulcal effacement: Mild to Moderate' END) AS factors,
 CASE WHEN mm >= 3 OR a > 0.5 THEN concat_ws('; ', CASE WHEN mm >= 10 THEN 'Severe midline shift (>10mm) - high subfalcine herniation risk' WHEN mm >= 5 THEN 'Moderate midline shift (5-10mm) - subfalcine herniation possible' WHEN mm >= 3 THEN 'Mild midline shift (3-5mm) - early mass effect' END, CASE WHEN a > 0.5 THEN 'Severe ventricular asymmetry - significant mass effect' END)
  ELSE 'No significant herniation risk - no measurable mass effect' END AS signs FROM (SELECT sc.*, CASE WHEN nf = 0 THEN 'Severe' ELSE 'Moderate to Severe' END AS word FROM sc JOIN su USING (case_id))""", GRID, BRAIN, SHIFT, CAND, _euclid("eu", "csf", "cd"), VENT, _near("nn", "seg > 0"), SULCI, POINTS)
def e10r(spark, sf):
    return mass_effect(spark, sf)


@query("e11_location", """SELECT case_id, CASE WHEN l > 0.9 * n THEN 'left' WHEN n - l > 0.9 * n THEN 'right' WHEN l > 0.6 * n THEN 'left-predominant' WHEN n - l > 0.6 * n THEN 'right-predominant' ELSE 'bilateral' END AS hemisphere,
 concat_ws(',', CASE WHEN frontal > 0.05 * n THEN 'frontal' END, CASE WHEN parietal > 0.05 * n THEN 'parietal' END, CASE WHEN temporal > 0.05 * n THEN 'temporal' END, CASE WHEN occipital > 0.05 * n THEN 'occipital' END, CASE WHEN deep_structures > 0.1 * n THEN 'deep structures' END) AS lobes,
 """ + f"{r('1 - sqrt((cx - 8) * (cx - 8) + (cy - 8) * (cy - 8) + (cz - 6) * (cz - 6) * 2.25) / 6.0', 'depth_score')}" + " FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE x < 8) AS l, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in LOBE_SQL.items()) + " FROM g WHERE seg > 0 GROUP BY 1)")
def e11(spark, sf):
    return rounded(X.location(grid(spark, sf)).select("case_id", "hemisphere", "lobes", "depth_score"))


_SHARES = "CASE WHEN {k} > {least} * n THEN 100.0 * {k} / n END"
_LOBE_LIST = ", ".join("{'share': " + _SHARES.format(k=k, least=0.1 if k == "deep_structures" else 0.05) + f", 'pos': -{i}, 'lobe': '{k}'}}" for i, k in enumerate(LOBE_SQL))


@query("e11_location_report", f"""SELECT case_id, CASE WHEN l > 0.9 * n THEN 'left' WHEN n - l > 0.9 * n THEN 'right' WHEN l > 0.6 * n THEN 'left-predominant' WHEN n - l > 0.6 * n THEN 'right-predominant' ELSE 'bilateral' END AS hemisphere,
 CASE WHEN l > 0.9 * n THEN 'Unilateral (left hemisphere)' WHEN n - l > 0.9 * n THEN 'Unilateral (right hemisphere)' WHEN l > 0.6 * n THEN 'Bilateral, left-predominant' WHEN n - l > 0.6 * n THEN 'Bilateral, right-predominant' ELSE 'Bilateral (crosses midline)' END AS laterality,
 CASE WHEN len(e) = 0 THEN 'location indeterminate' ELSE array_to_string(list_transform(e, lambda x: replace(x.lobe, '_', ' ')), ',') END AS lobes,
 coalesce(b.lobe, 'indeterminate') AS primary_lobe, {r('coalesce(b.share, 0)', 'primary_percent')},
 CASE WHEN d > 0.7 THEN 'Deep (periventricular/central)' WHEN d > 0.4 THEN 'Subcortical' ELSE 'Cortical/Superficial' END AS depth, {r('d', 'depth_score')},
 CASE WHEN len(list_filter(e, lambda x: x.lobe <> 'deep_structures')) = 0 THEN 'gyral localization not determined' ELSE concat_ws(',',
  CASE WHEN frontal > 0.05 * n THEN CASE WHEN cz > 0.7 * 12 THEN 'superior frontal gyrus region' WHEN cz > 0.5 * 12 THEN 'middle frontal gyrus region' ELSE 'inferior frontal gyrus region' END END,
  CASE WHEN parietal > 0.05 * n THEN CASE WHEN cz > 0.65 * 12 THEN 'superior parietal lobule region' ELSE 'inferior parietal lobule region' END END,
  CASE WHEN temporal > 0.05 * n THEN CASE WHEN cz > 0.45 * 12 THEN 'superior temporal gyrus region' WHEN cz > 0.3 * 12 THEN 'middle temporal gyrus region' ELSE 'inferior temporal gyrus region' END END,
  CASE WHEN occipital > 0.05 * n THEN 'occipital cortex region' END) END AS gyri
 FROM (SELECT *, list_sort(e, 'DESC')[1] AS b FROM (SELECT *, 1 - sqrt((cx - 8) * (cx - 8) + (cy - 8) * (cy - 8) + (cz - 6) * (cz - 6) * 2.25) / 6.0 AS d, list_filter([{_LOBE_LIST}], lambda x: x.share IS NOT NULL) AS e FROM
  (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE x < 8) AS l, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, """ + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in LOBE_SQL.items()) + " FROM g WHERE seg > 0 GROUP BY 1)))")
def e11r(spark, sf):
    return rounded(X.location(grid(spark, sf)))


@query("e18_e20_shape", f"SELECT case_id, {r('n * 0.0015', 'volume_cm3')}, {r('s * (1 + 1.5 + 1.5) / 3', 'surface_mm2')}, {r('least(1.0, 4 * pi() * pow(3 * n * 1.5 / (4 * pi()), 2.0 / 3) / (s * 4.0 / 3))', 'sphericity')}, {r('least(1.0, 36 * pi() * pow(n * 1.5, 2) / pow(s * 4.0 / 3, 3))', 'compactness')} FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE d <= 1) AS s FROM dp GROUP BY 1)", GRID, _depth("dp", "seg > 0"))
def e18(spark, sf):
    return rounded(S.shape(grid(spark, sf)).select("case_id", "volume_cm3", "surface_mm2", "sphericity", "compactness"))


EIGEN = """ei AS (SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM (SELECT *, acos(greatest(-1.0, least(1.0, det / (2 * pow(p, 3))))) / 3 AS phi FROM (SELECT *,
 sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p, (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) AS det
 FROM (SELECT *, (xx + yy + zz) / 3 AS q FROM (SELECT case_id, var_samp(x) AS xx, var_samp(y) AS yy, var_samp(z * 1.5) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z * 1.5) AS xz, covar_samp(y, z * 1.5) AS yz FROM g WHERE seg > 0 GROUP BY 1)))))"""
_AXES = "SELECT *, 3 * q - e1 - e3 AS e2, CASE WHEN e3 > 0 THEN sqrt(e1 / e3) ELSE 1 END AS k FROM ei"


@query("e21_e22_shape_classes", f"""SELECT case_id, volume_cm3, surface_mm2, {r('sp', 'sphericity')}, compactness, {r('k', 'elongation')}, {r('2 * sqrt(greatest(e1, 0))', 'axis1_mm')}, {r('2 * sqrt(greatest(e2, 0))', 'axis2_mm')}, {r('2 * sqrt(greatest(e3, 0))', 'axis3_mm')},
 CASE WHEN sp > 0.8 THEN 'Spherical/round' WHEN sp > 0.6 THEN 'Ovoid' WHEN sp > 0.4 THEN 'Irregular' ELSE 'Highly irregular/complex' END AS shape_class, CASE WHEN k > 2.5 THEN 'Elongated' WHEN k > 1.5 THEN 'Mildly elongated' ELSE 'Roughly isotropic' END AS elongation_class
 FROM (SELECT case_id, {r('n * 0.0015', 'volume_cm3')}, {r('s * (1 + 1.5 + 1.5) / 3', 'surface_mm2')}, least(1.0, 4 * pi() * pow(3 * n * 1.5 / (4 * pi()), 2.0 / 3) / (s * 4.0 / 3)) AS sp, {r('least(1.0, 36 * pi() * pow(n * 1.5, 2) / pow(s * 4.0 / 3, 3))', 'compactness')} FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE d <= 1) AS s FROM dp GROUP BY 1)) JOIN ({_AXES}) USING (case_id)""", GRID, _depth("dp", "seg > 0"), EIGEN)
def e21(spark, sf):
    return rounded(S.shape(grid(spark, sf)))



@query("d20_covariance", "SELECT case_id, " + ", ".join(r(f"{f}", n) for f, n in (("var_samp(x)", "xx"), ("var_samp(y)", "yy"), ("var_samp(z * 1.5)", "zz"), ("covar_samp(x, y)", "xy"), ("covar_samp(x, z * 1.5)", "xz"), ("covar_samp(y, z * 1.5)", "yz"))) + " FROM g WHERE seg > 0 GROUP BY 1")
def d20(spark, sf):
    g = grid(spark, sf).where(region("wt"))
    p = {a: F.col(a) * F.col(f"d{a}") for a in "xyz"}
    return rounded(g.groupBy("case_id").agg(*[F.var_samp(p[a]).alias(a + a) for a in "xyz"], *[F.covar_samp(p[a], p[b]).alias(a + b) for a, b in ("xy", "xz", "yz")]))


BORDER = "bo AS (SELECT gr.case_id, count(*) AS surface, avg(grad) AS m, stddev_pop(grad) AS s FROM gr JOIN dp USING (case_id, x, y, z) WHERE dp.d <= 1 GROUP BY 1)"


@query("e23_border_regularity", f"SELECT case_id, surface, {r('1 / (1 + s / m)', 'regularity')}, CASE WHEN 1 / (1 + s / m) > 0.7 THEN 'Smooth contour' WHEN 1 / (1 + s / m) > 0.5 THEN 'Mildly lobulated' WHEN 1 / (1 + s / m) > 0.3 THEN 'Lobulated' ELSE 'Highly irregular' END AS classification FROM bo", GRID, _euclid("ea", "seg = 0"), _euclid("eb", "seg > 0"), SIGNED, _grad("gr", "s", "sd"), _depth("dp", "seg > 0"), BORDER)
def e23(spark, sf):
    return rounded(S.border(grid(spark, sf)))


MARGIN = """mg AS (SELECT g.case_id, abs(avg(t1ce) FILTER (WHERE seg > 0) - avg(t1ce) FILTER (WHERE nn.d BETWEEN 1 AND 5)) / avg(t1ce) FILTER (WHERE nn.d BETWEEN 1 AND 5) AS c,
 abs(avg(t1ce) FILTER (WHERE dp.d <= 1) - avg(t1ce) FILTER (WHERE nn.d = 1)) / (stddev_pop(t1ce) FILTER (WHERE dp.d <= 1) + stddev_pop(t1ce) FILTER (WHERE nn.d = 1) + 1e-6) AS s
 FROM g JOIN nn USING (case_id, x, y, z) LEFT JOIN dp USING (case_id, x, y, z) GROUP BY 1)"""


@query("e24_margin", f"SELECT case_id, {r('least(1, (c + s) / 2)', 'sharpness')}, {r('c', 'contrast')}, {r('s', 'border_gradient')}, CASE WHEN (c + s) / 2 > 0.6 THEN 'Sharp transition' WHEN (c + s) / 2 > 0.4 THEN 'Moderate transition' WHEN (c + s) / 2 > 0.2 THEN 'Gradual transition' ELSE 'Infiltrative transition' END AS classification FROM mg", GRID, _near("nn", "seg > 0"), _depth("dp", "seg > 0"), MARGIN)
def e24(spark, sf):
    return rounded(S.margin(grid(spark, sf)))


FLUID = """fl AS (SELECT case_id, count(*) FILTER (WHERE seg > 0) AS wt, count(*) FILTER (WHERE seg = 1) AS ncr, count(*) FILTER (WHERE seg = 1 AND t1 < 1.5 * pa AND t2 > 0.8 * pb AND flair < 2 * pc) AS f, stddev_pop(t2) FILTER (WHERE seg = 1) / avg(t2) FILTER (WHERE seg = 1) AS cv, avg(flair) FILTER (WHERE seg = 1) / avg(t2) FILTER (WHERE seg = 1) AS fr
 FROM g JOIN (SELECT case_id, quantile_cont(t1, 0.1) FILTER (WHERE t1 > 0) AS pa, quantile_cont(t2, 0.85) FILTER (WHERE t2 > 0) AS pb, quantile_cont(flair, 0.2) FILTER (WHERE flair > 0) AS pc FROM g GROUP BY 1) USING (case_id) GROUP BY 1)"""


@query("e25_b24_cystic", f"SELECT case_id, {r('f * 0.0015', 'cystic_cm3')}, {r('100.0 * f / wt', 'cystic_percent')}, {r('100 - 100.0 * f / wt', 'solid_percent')}, CASE WHEN 100.0 * f / wt > 70 THEN 'Predominantly cystic' WHEN 100.0 * f / wt > 40 THEN 'Cystic with solid component' WHEN 100.0 * f / wt > 15 THEN 'Solid with cystic component' WHEN ncr > 0 AND cv > 0.3 THEN 'Solid with necrosis' WHEN ncr > 0 THEN 'Solid with possible cyst' ELSE 'Solid' END AS classification, CASE WHEN cv < 0.2 THEN 'Homogeneous' WHEN cv < 0.4 THEN 'Mildly heterogeneous' ELSE 'Heterogeneous' END AS t2_homogeneity, CASE WHEN fr < 0.7 THEN 'Present (suggests true cyst)' ELSE 'Absent (suggests necrosis/protein)' END AS flair_suppression FROM fl", GRID, FLUID)
def e25(spark, sf):
    return rounded(S.cystic(grid(spark, sf)))


@query("e26_necrosis", f"""SELECT case_id, ncr > 0 AS present, {r('ncr * 0.0015', 'necrosis_cm3')}, {r('100.0 * ncr / wt', 'percent')}, CASE WHEN ncr = 0 THEN 'No necrosis' WHEN 100.0 * ncr / wt > 50 THEN 'Extensive necrosis' WHEN 100.0 * ncr / wt > 25 THEN 'Moderate necrosis' WHEN 100.0 * ncr / wt > 10 THEN 'Focal necrosis' ELSE 'Minimal necrosis' END AS pattern,
 CASE WHEN ncr = 0 THEN NULL WHEN dist < 0.3 * rad THEN 'Central' WHEN dist < 0.6 * rad THEN 'Eccentric' ELSE 'Peripheral' END AS location FROM (SELECT case_id, count(*) FILTER (WHERE seg = 1) AS ncr, count(*) AS wt, cbrt(3 * count(*) FILTER (WHERE seg IN (1, 3)) * 1.5 / (4 * pi())) AS rad,
 sqrt(pow(avg(x) FILTER (WHERE seg = 1) - avg(x) FILTER (WHERE seg IN (1, 3)), 2) + pow(avg(y) FILTER (WHERE seg = 1) - avg(y) FILTER (WHERE seg IN (1, 3)), 2) + 2.25 * pow(avg(z) FILTER (WHERE seg = 1) - avg(z) FILTER (WHERE seg IN (1, 3)), 2)) AS dist FROM g WHERE seg > 0 GROUP BY 1)""")
def e26(spark, sf):
    return rounded(S.necrosis(grid(spark, sf)))


HOLES = "ho AS (SELECT case_id, count(*) AS h FROM bg WHERE component NOT IN (SELECT component FROM bg WHERE x IN (0, 15) OR y IN (0, 15) OR z IN (0, 11)) GROUP BY 1)"
#: Rules of a segmentation: condition, points, text (the first and fourth are issues).
_RULES = (
    ("wt = 0", 50, "'No tumor segmentation detected'"), ("wt > 0 AND v < 0.5", 10, "'Very small tumor volume (' || printf('%.2f', v) || ' cm³) - may be artifact'"),
    ("v > 300", 10, "'Very large tumor volume (' || printf('%.0f', v) || ' cm³) - verify boundaries'"), ("tc > 1.01 * wt", 20, "'Tumor core volume exceeds whole tumor - label inconsistency'"),
    ("parts > 5", 5, "'Multiple disconnected components (' || parts || ') - possible over-segmentation'"), ("stray > 0.05 * et", 5, "'Some enhancing tumor voxels outside tumor core boundary'"),
    ("wt > 0 AND hf > 0.1", 5, "'Segmentation has internal holes (' || printf('%.0f', hf * 100) || '% of volume)'"), ("at_boundary", 10, "'Tumor extends to image boundary - may be truncated'"),
)
_TEXTS = lambda keep: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for k, (c, _, t) in enumerate(_RULES) if k in keep) + ")"
GRADES = f"""sq AS (SELECT *, 100 - ({' + '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for c, p, _ in _RULES)}) AS score, {_TEXTS(range(8))} AS findings, {_TEXTS((0, 3))} AS issues, {_TEXTS((1, 2, 4, 5, 6, 7))} AS warnings FROM (SELECT *, wt * 0.0015 AS v, CASE WHEN wt > 0 THEN coalesce(h, 0) / wt ELSE 0 END AS hf FROM (
 SELECT case_id, count(*) FILTER (WHERE seg > 0) AS wt, count(*) FILTER (WHERE seg IN (1, 3, 4)) AS tc, count(*) FILTER (WHERE seg IN (3, 4)) AS et, 0 AS stray, bool_or(seg > 0 AND (x < 3 OR x >= 13 OR y < 3 OR y >= 13 OR z < 3 OR z >= 9)) AS at_boundary FROM g GROUP BY 1)
 LEFT JOIN ho USING (case_id) LEFT JOIN (SELECT case_id, count(DISTINCT component) AS parts FROM cc GROUP BY 1) USING (case_id)))"""


@query("e27_segmentation_quality", f"SELECT case_id, score, CASE WHEN wt = 0 THEN 'Poor' WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Unacceptable' END AS grade, coalesce(parts, 0) AS parts, {r('hf', 'hole_fraction')}, at_boundary, findings, issues, warnings FROM sq", GRID, _parts("cc", "seg > 0", 3), _parts("bg", "seg = 0", 1), HOLES, GRADES)
def e27(spark, sf):
    return rounded(Q.segmentation_quality(grid(spark, sf), Workspace(spark, "e27")))


IMAGE = """lo AS (SELECT case_id, brain, s.sequence, s.v FROM b, LATERAL (VALUES ('T1', b.t1), ('T1ce', b.t1ce), ('T2', b.t2), ('FLAIR', b.flair)) s(sequence, v)),
qq AS (SELECT case_id, sequence, quantile_cont(v, 0.01) FILTER (WHERE brain) AS q1, quantile_cont(v, 0.25) FILTER (WHERE brain) AS q25, quantile_cont(v, 0.75) FILTER (WHERE brain) AS q75, quantile_cont(v, 0.99) FILTER (WHERE brain) AS q99, quantile_cont(v, 0.1) FILTER (WHERE v > 0) AS p10 FROM lo GROUP BY 1, 2),
im AS (SELECT case_id, sequence, avg(v) FILTER (WHERE brain) AS mean, stddev_pop(v) FILTER (WHERE brain) AS std, CASE WHEN count(*) FILTER (WHERE NOT brain AND v > 0 AND v < p10) > 100 THEN stddev_pop(v) FILTER (WHERE NOT brain AND v > 0 AND v < p10) ELSE stddev_pop(v) FILTER (WHERE brain) END AS noise,
 count(*) FILTER (WHERE brain AND v = 0) / count(*) FILTER (WHERE brain) AS zf, count(*) FILTER (WHERE brain AND (v > q99 + 3 * (q75 - q25) OR v < q1 - 3 * (q75 - q25))) / count(*) FILTER (WHERE brain) AS xf FROM lo JOIN qq USING (case_id, sequence) GROUP BY 1, 2)"""


@query("e28_image_quality", f"SELECT case_id, sequence, {r('mean / noise', 'snr')}, {r('zf', 'zero_fraction')}, {r('xf', 'outlier_fraction')}, {r('mean', 'mean')}, {r('std', 'std')}, CAST(zf > 0.01 AS INT) + CAST(xf > 0.01 AS INT) AS issues, CASE WHEN mean / noise > 20 AND zf <= 0.01 AND xf <= 0.01 THEN 'Excellent' WHEN mean / noise > 10 AND NOT (zf > 0.01 AND xf > 0.01) THEN 'Good' WHEN mean / noise > 5 THEN 'Fair' ELSE 'Poor' END AS quality FROM im", GRID, BRAIN, IMAGE)
def e28(spark, sf):
    return rounded(Q.image_quality(grid(spark, sf)))


_NAMED = {"t1": "T1", "t1ce": "T1ce", "t2": "T2", "flair": "FLAIR"}
ARTIFACTS = f"""mid AS (SELECT case_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM b WHERE brain GROUP BY 1),
ra AS (SELECT b.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS r FROM b JOIN mid USING (case_id)),
rf AS (SELECT ra.*, max(r) FILTER (WHERE brain) OVER (PARTITION BY case_id) AS far, so.grad, coalesce(dp.d, 0) AS depth FROM ra JOIN (SELECT case_id, x, y, z, grad FROM so) so USING (case_id, x, y, z) LEFT JOIN dp USING (case_id, x, y, z)),
ar AS (SELECT case_id, count(*) FILTER (WHERE brain AND r < 0.3 * far) AS ni, count(*) FILTER (WHERE brain AND r > 0.7 * far) AS no, avg(t1) FILTER (WHERE brain AND r > 0.7 * far) / avg(t1) FILTER (WHERE brain AND r < 0.3 * far) AS bias,
 concat_ws(',', {", ".join(f"CASE WHEN count(*) FILTER (WHERE NOT brain AND {k} > 0) > 1000 AND stddev_pop({k}) FILTER (WHERE NOT brain AND {k} > 0) / avg({k}) FILTER (WHERE NOT brain AND {k} > 0) > 0.5 THEN '{v}' END" for k, v in _NAMED.items())}) AS ghosting,
 count(*) FILTER (WHERE brain AND t1 = 0) AS nz, avg(z) FILTER (WHERE brain AND t1 = 0) < 0.5 * avg(z) FILTER (WHERE brain) AS low,
 CAST(bool_or(x < 5 AND t1 > 0) AS INT) + CAST(bool_or(x >= 11 AND t1 > 0) AS INT) + CAST(bool_or(y < 5 AND t1 > 0) AS INT) + CAST(bool_or(y >= 11 AND t1 > 0) AS INT) AS edges,
 count(*) FILTER (WHERE seg > 0 AND depth <= 2) AS nr, stddev_pop(grad) FILTER (WHERE seg > 0 AND depth <= 2) / avg(grad) FILTER (WHERE seg > 0 AND depth <= 2) AS ring FROM rf GROUP BY 1),
af AS (SELECT *, list_filter([CASE WHEN ni > 100 AND no > 100 AND (bias < 0.7 OR bias > 1.4) THEN 'Intensity inhomogeneity' END, CASE WHEN ghosting <> '' THEN 'Possible motion artifact' END, CASE WHEN nz > 100 AND low THEN 'Susceptibility artifact' END,
 CASE WHEN edges >= 3 THEN 'Possible wrap-around' END, CASE WHEN nr > 100 AND ring > 1.5 THEN 'Possible Gibbs ringing' END], lambda v: v IS NOT NULL) AS found FROM ar)"""


@query("e29_artifacts", f"SELECT case_id, array_to_string(found, ', ') AS artifacts, CASE WHEN len(found) = 0 THEN 'None' WHEN len(found) <= 2 THEN 'Mild' ELSE 'Moderate to Severe' END AS severity, CASE WHEN ni > 100 AND no > 100 THEN round(bias, 6) + 0.0 END AS bias_ratio, ghosting, edges, CASE WHEN nr > 100 THEN round(ring, 6) + 0.0 END AS edge_cv, CASE WHEN len(found) > 1 THEN 'Review recommended' ELSE 'Minimal impact expected' END AS impact FROM af", GRID, BRAIN, SOBEL, _depth("dp", "seg > 0"), ARTIFACTS)
def e29(spark, sf):
    return rounded(Q.artifacts(grid(spark, sf)))



@query("e30_confidence", "SELECT DISTINCT case_id, m AS measurement, c AS confidence FROM g, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in Q.CONFIDENCE.items()) + ") t(m, c)")
def e30(spark, sf):
    return Q.confidence(voxel_view(spark, sf))


def caveats(spark, sf):
    g = grid(spark, sf)
    et = g.groupBy("case_id").agg(F.count_if(region("et")).alias("et"))
    return Q.caveats(Q.segmentation_quality(g, Workspace(spark, "e31")), Q.overall_quality(Q.image_quality(g)), et).select("case_id", F.explode("caveats").alias("caveat"))


_QUALITY = "CASE WHEN mean / noise > 20 AND zf <= 0.01 AND xf <= 0.01 THEN 'Excellent' WHEN mean / noise > 10 AND NOT (zf > 0.01 AND xf > 0.01) THEN 'Good' WHEN mean / noise > 5 THEN 'Fair' ELSE 'Poor' END"
OVERALL = f"ov AS (SELECT case_id, max(snr) FILTER (WHERE sequence = 'T2') AS t2_snr, CASE WHEN bool_and(q = 'Excellent') THEN 'Excellent' WHEN bool_and(q IN ('Excellent', 'Good')) THEN 'Good' WHEN bool_or(q = 'Poor') THEN 'Poor' ELSE 'Fair' END AS overall FROM (SELECT case_id, sequence, mean / noise AS snr, {_QUALITY} AS q FROM im) GROUP BY 1)"


@query("e31_caveats", """SELECT case_id, unnest(list_filter([CASE WHEN et = 0 THEN 'Non-enhancing pattern: Can be seen with lower-grade glioma, treatment effect, or other pathology; clinical and histopathological correlation required' END,
 CASE WHEN at_boundary THEN 'Tumor at image boundary: Volume may be underestimated' END, CASE WHEN t2_snr < 6 THEN 'Low T2 SNR (' || printf('%.1f', t2_snr) || '): Necrosis fraction and cystic/solid classification less reliable' END,
 CASE WHEN overall IN ('Fair', 'Poor') THEN 'Suboptimal image quality may affect measurement accuracy' END, 'Model optimized for adult gliomas; performance may vary for other tumor types', 'Peritumoral edema vs infiltrating tumor cannot be distinguished on conventional MRI'], lambda x: x IS NOT NULL)) AS caveat
 FROM (SELECT case_id, count(*) FILTER (WHERE seg IN (3, 4)) AS et, bool_or(seg > 0 AND (x < 3 OR x >= 13 OR y < 3 OR y >= 13 OR z < 3 OR z >= 9)) AS at_boundary FROM g GROUP BY 1) JOIN ov USING (case_id)""", GRID, BRAIN, IMAGE, OVERALL)
def e31(spark, sf):
    return caveats(spark, sf)


@query("e38_reliability_warnings", """SELECT case_id, sequence, CASE sequence WHEN 'T2' THEN 'necrosis_fraction,cystic_solid_classification,edema_extent' ELSE 'enhancement_analysis,margin_sharpness' END AS affected,
 'Low ' || sequence || ' SNR (' || printf('%.1f', mean / noise) || ') may reduce reliability of ' || CASE sequence WHEN 'T2' THEN 'necrosis/cystic fraction and edema measurements' ELSE 'enhancement and margin measurements' END AS warning FROM im WHERE sequence IN ('T2', 'T1ce') AND mean / noise < 6
 UNION ALL SELECT case_id, 'all', '', 'Overall image quality is ' || overall || '; interpret quantitative measurements with caution' FROM ov WHERE overall IN ('Fair', 'Poor')""", GRID, BRAIN, IMAGE, OVERALL)
def e38(spark, sf):
    q = Q.image_quality(grid(spark, sf))
    return S2.reliability_warnings(q, Q.overall_quality(q))


_HEMI = "CASE WHEN l > 0.9 * n THEN 'left' WHEN n - l > 0.9 * n THEN 'right' WHEN l > 0.6 * n THEN 'left-predominant' WHEN n - l > 0.6 * n THEN 'right-predominant' ELSE 'bilateral' END"


@query("e37_laterality_check", f"""SELECT case_id, a AS location_method, b AS centroid_method, a = 'bilateral' OR split_part(a, '-', 1) = b AS consistent, CASE WHEN a = 'bilateral' THEN 'Bilateral tumor - crosses midline' WHEN split_part(a, '-', 1) = b THEN 'Hemisphere determination consistent across methods'
 ELSE 'Hemisphere mismatch: location analysis suggests ' || a || ', centroid analysis suggests ' || b || '. Tumor may be near midline.' END AS note FROM (SELECT case_id, {_HEMI} AS a, CASE WHEN tx < mid THEN 'left' ELSE 'right' END AS b FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE x < 8) AS l FROM g WHERE seg > 0 GROUP BY 1) JOIN sh USING (case_id))""", GRID, BRAIN, SHIFT)
def e37(spark, sf):
    g = grid(spark, sf)
    return S2.laterality_check(X.location(g), X.midline_shift(g))


FLUIDS = ",\n".join([
    _depth("fd", "csf", "csf"), "fo AS (SELECT csf.*, coalesce(fd.d, 0) > 1 AS core FROM csf LEFT JOIN fd USING (case_id, x, y, z))", _near("fn", "core", "fo"),
    "fl AS (SELECT fo.*, coalesce(fn.d <= 1, false) AS fluid FROM fo LEFT JOIN fn USING (case_id, x, y, z))", _parts("vc", "fluid", 2, "fl"),
    "vt AS (SELECT fl.*, k.component IS NOT NULL AS vent FROM fl LEFT JOIN (SELECT case_id, x, y, z, component FROM vc WHERE component IN (SELECT component FROM vc GROUP BY 1 HAVING count(*) > 5 AND abs(avg(x) - 8) < 0.3 * 16)) k USING (case_id, x, y, z))",
])
SYSTEM = """vs AS (SELECT vt.case_id, count(*) FILTER (WHERE vent AND x < 8) AS nl, count(*) FILTER (WHERE vent AND x >= 8) AS nr, count(*) FILTER (WHERE brain AND seg = 0) AS nb, count(*) FILTER (WHERE vent AND nn.d <= 5) AS near, quantile_cont(y, 0.75) FILTER (WHERE vent) AS front FROM vt LEFT JOIN nn USING (case_id, x, y, z) GROUP BY 1),
wi AS (SELECT case_id, max(n) AS width FROM (SELECT vt.case_id, y, z, count(*) AS n FROM vt JOIN vs USING (case_id) WHERE vent AND y >= floor(front) GROUP BY 1, 2, 3) GROUP BY 1),
sy AS (SELECT *, nl + nr AS n, CASE WHEN nb > 0 THEN 100.0 * (nl + nr) / nb ELSE 0 END AS vbr, coalesce(width / 16.0, 0) AS evans, CASE WHEN nl + nr > 0 THEN abs(nl - nr) / (nl + nr) ELSE 0 END AS asym, CASE WHEN nl + nr > 0 THEN near / (nl + nr) ELSE 0 END AS ob FROM vs LEFT JOIN wi USING (case_id))"""


#: The derived grids are small, so components of more than 5 voxels pass as ventricles here.
@query("e32_e33_ventricular_system", f"""SELECT case_id, {r('n * 0.0015', 'total_cm3')}, {r('nl * 0.0015', 'left_cm3')}, {r('nr * 0.0015', 'right_cm3')}, {r('vbr', 'vbr')}, {r('asym', 'asymmetry')}, {r('evans', 'evans')}, {r('ob', 'obstruction')},
 CASE WHEN vbr < 2 THEN 'Normal' WHEN vbr < 4 THEN 'Mildly prominent' WHEN vbr < 6 THEN 'Moderately dilated' ELSE 'Markedly dilated' END AS size, CASE WHEN evans > 0.3 AND vbr > 5 THEN 'Communicating hydrocephalus suggested' WHEN vbr > 7 THEN 'Ventriculomegaly noted' ELSE 'No hydrocephalus' END AS hydrocephalus,
 CASE WHEN asym < 0.15 THEN 'Symmetric' ELSE 'Asymmetric (' || CASE WHEN nl > nr THEN 'left' WHEN nr > nl THEN 'right' ELSE 'symmetric' END || ' larger)' END AS symmetry FROM sy""", GRID, BRAIN, CSF, FLUIDS, _near("nn", "seg > 0"), SYSTEM)
def e33(spark, sf):
    return rounded(N.ventricular_system(grid(spark, sf), Workspace(spark, "e33"), least=5))


TISSUE = """td AS (SELECT vt.*, vn.d AS vd, bd.d AS depth FROM vt LEFT JOIN vn USING (case_id, x, y, z) LEFT JOIN bd USING (case_id, x, y, z)),
tq AS (SELECT case_id, quantile_cont(depth, 0.6) FILTER (WHERE brain) AS q60, quantile_cont(depth, 0.4) FILTER (WHERE brain) AS q40 FROM td GROUP BY 1),
ta AS (SELECT case_id, count(*) FILTER (WHERE brain AND seg = 0) AS n, count(*) FILTER (WHERE brain) AS nb, count(*) FILTER (WHERE vd BETWEEN 1 AND 10 AND brain AND seg = 0) AS na, count(*) FILTER (WHERE brain AND seg = 0 AND depth > q60) AS nd, count(*) FILTER (WHERE brain AND seg = 0 AND depth < q40) AS nc,
 avg(flair) FILTER (WHERE vd BETWEEN 1 AND 10 AND brain AND seg = 0) AS fa, avg(flair) FILTER (WHERE brain AND seg = 0 AND depth < q40) AS fc, avg(t1) FILTER (WHERE brain AND seg = 0 AND depth > q60) AS tdeep, avg(t1) FILTER (WHERE brain AND seg = 0 AND depth < q40) AS tcort FROM td JOIN tq USING (case_id) GROUP BY 1),
tw AS (SELECT *, CASE WHEN na > 0 AND fc > 0 THEN fa / fc ELSE 1 END AS pv, CASE WHEN nd > 100 AND (CASE WHEN nc > 100 THEN tcort ELSE tdeep END) > 0 THEN tdeep / CASE WHEN nc > 100 THEN tcort ELSE tdeep END ELSE 1 END AS gw FROM ta),
tz AS (SELECT *, na > 0 AND pv > 1.15 AS disease, CASE WHEN nd <= 100 THEN 'Could not assess' WHEN gw > 1.1 THEN 'Preserved' WHEN gw > 1.0 THEN 'Mildly reduced' ELSE 'Reduced' END AS kept FROM tw)"""


@query("e34_parenchyma", f"SELECT case_id, {r('n * 0.0015', 'normal_cm3')}, {r('nb * 0.0015', 'brain_cm3')}, {r('pv', 'pv')}, disease AS white_matter_disease, {r('gw', 'gw')}, kept AS differentiation, CASE WHEN n = 0 THEN 'Unable to assess' WHEN NOT disease AND kept = 'Preserved' THEN 'Normal' ELSE 'Abnormal findings present' END AS overall FROM tz", GRID, BRAIN, CSF, FLUIDS, _near("vn", "vent", "vt"), _euclid("bd", "NOT brain", "vt"), TISSUE)
def e34(spark, sf):
    return rounded(N.parenchyma(grid(spark, sf), Workspace(spark, "e34"), least=5))


@query("e35_vessels", f"SELECT case_id, {r('nv * 0.0015', 'void_cm3')}, CASE WHEN ni = 0 THEN 'Could not assess' WHEN nv / ni > 0.001 AND nv / ni < 0.05 THEN 'Present' WHEN nv / ni < 0.001 THEN 'Not well visualized' ELSE 'Prominent' END AS flow_voids, {r('q', 'peritumoral_ratio')}, CASE WHEN q > 1.5 THEN 'Possible' ELSE 'Not evident' END AS involvement FROM (SELECT case_id, count(*) FILTER (WHERE brain AND z < 4) AS ni, count(*) FILTER (WHERE brain AND z < 4 AND t1 < p AND seg = 0) AS nv, avg(t1ce) FILTER (WHERE brain AND d BETWEEN 1 AND 10) / avg(t1) FILTER (WHERE brain AND d BETWEEN 1 AND 10) AS q FROM b JOIN nn USING (case_id, x, y, z) JOIN (SELECT case_id, quantile_cont(t1, 0.05) FILTER (WHERE brain AND z < 4) AS p FROM b GROUP BY 1) USING (case_id) GROUP BY 1)", GRID, BRAIN, _near("nn", "seg > 0"))
def e35(spark, sf):
    return rounded(N.vessels(grid(spark, sf)))
