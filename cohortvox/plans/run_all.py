"""Findings of a growing cohort: only cases without findings are run, and a run that broke off goes on.

A run has a folder of its own.  Its cases are fixed by the first table written
there; every step's table after that has a fixed place, and a step whose table
is whole is read instead of computed.  Results of finished runs are never
touched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.plans.summary import findings
from cohortvox.sources.workspace import Workspace

#: Cases of a run whose ids are broadcast to the grid.
BROADCAST_CASES = 100_000


class Steps(Workspace):
    """A workspace in a fixed folder that keeps what an earlier attempt wrote whole."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, "steps")
        self.root = root
        self.computed: list[str] = []

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        if not self.exists(path):
            df.write.mode("overwrite").parquet(path)
            self.computed.append(name)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Tables stay until the run is finished, as a later attempt reads them."""


def _runs(spark: SparkSession, out: str) -> int:
    """Runs begun so far; they are numbered without gaps."""
    ws, n = Workspace(spark, "runs"), 0
    while ws.exists(f"{out}/run={n}/cases"):
        n += 1
    return n


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    """All findings so far, None before the first run has finished."""
    ws = Workspace(spark, "runs")
    done = [f"{out}/run={k}/result" for k in range(_runs(spark, out)) if ws.exists(f"{out}/run={k}/result")]
    return spark.read.parquet(*done) if done else None


def run_cases(spark: SparkSession, grid: DataFrame, out: str, ventricle_voxels: int = 1000, available: DataFrame | None = None) -> DataFrame:
    """Findings of every case of ``grid``; those of earlier calls with the same ``out`` are kept.

    Goes on with a run that broke off, then runs the cases that have no findings.
    """
    ws = Workspace(spark, "runs")
    n = _runs(spark, out)
    if n and not ws.exists(f"{out}/run={n - 1}/result"):
        _run(spark, grid, f"{out}/run={n - 1}", ventricle_voxels, available)
    known = finished(spark, out)
    cases = grid.select("case_id").distinct()
    todo = cases if known is None else cases.join(known.select("case_id"), "case_id", "left_anti")
    if not todo.isEmpty():
        n = _runs(spark, out)
        todo.write.mode("overwrite").parquet(f"{out}/run={n}/cases")
        _run(spark, grid, f"{out}/run={n}", ventricle_voxels, available)
    return finished(spark, out)


def _run(spark: SparkSession, grid: DataFrame, root: str, ventricle_voxels: int, available: DataFrame | None) -> Steps:
    cases = spark.read.parquet(f"{root}/cases")
    some = F.broadcast(cases) if cases.count() <= BROADCAST_CASES else cases
    steps = Steps(spark, f"{root}/steps")
    findings(grid.join(some, "case_id", "left_semi"), steps, ventricle_voxels, available).write.mode("overwrite").parquet(f"{root}/result")
    steps.delete(steps.root)
    return steps
