"""Cases that arrive file by file, across batches and restarts.

The files seen of each case are kept as state of the stream, so a case is
announced in the batch that brings its last required file, whichever batches
brought the others, and never again.  State and source offsets are in the
checkpoint; results are written to a folder of their own for each batch number
and overwritten when a batch is repeated, so a restart neither loses nor
doubles a case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortvox.plans.summary import findings
from cohortvox.sources import ingest
from cohortvox.sources.manifest import REQUIRED, manifest
from cohortvox.sources.voxels import dense
from cohortvox.sources.workspace import Workspace

#: What findings need of a case.
NEEDED = (*REQUIRED, "seg")
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def uploads(spark: SparkSession, folder: str, most: int = 1_000) -> DataFrame:
    """The stream of paths of volume files that appear below a folder, at most so many a batch; contents are not read."""
    s = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*")
    return s.option("maxFilesPerTrigger", most).load(folder).select("path")


def completed(files: DataFrame, need: tuple[str, ...] = NEEDED) -> DataFrame:
    """``(case_id, paths)`` of each case in the batch that completes it, from a stream of paths.

    A case's state is its files (a handful) and whether it was announced.  Files
    of neither naming are ignored; a repeated path counts once; a file that
    comes after the case was announced does not announce it again.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, paths, told = state.get if state.exists else ([], [], False)
        seen = dict(zip(paths, seqs))
        for part in parts:
            seen.update(zip(part["path"], part["seq"]))
        ready = not told and set(need) <= set(seen.values())
        order = sorted(seen)
        state.update(([seen[p] for p in order], order, told or ready))
        if ready:
            yield pd.DataFrame({"case_id": [key[0]], "paths": [order]})

    known = manifest(files).where("seq is not null").select("case_id", "path", "seq")
    return known.groupBy("case_id").applyInPandasWithState(
        step, "case_id string, paths array<string>", "seqs array<string>, paths array<string>, told boolean", "append", GroupStateTimeout.NoTimeout)


def each_case(cases: DataFrame, analyse: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Runs ``analyse(cases, batch)`` on the cases of each batch and writes its rows to ``out/batch=<number>``."""

    def write(batch: DataFrame, k: int) -> None:
        if not batch.isEmpty():
            analyse(batch, k).write.mode("overwrite").parquet(f"{out}/batch={k}")

    w = cases.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def case_findings(spark: SparkSession, volumes: str, ventricle_voxels: int = 1000) -> Callable[[DataFrame, int], DataFrame]:
    """An ``analyse`` function: reads the files of a batch's cases and returns their findings.

    Paths of one batch are listed on the driver (``uploads`` bounds them);
    voxels go to ``volumes/batch=<number>``, overwritten on a repeat.
    """

    def analyse(cases: DataFrame, k: int) -> DataFrame:
        files = [r.path for r in cases.select(F.explode("paths").alias("path")).collect()]
        voxels, geometry = ingest.ingest(spark, files, f"{volumes}/batch={k}")
        return findings(dense(voxels, geometry.drop("description")), Workspace(spark, f"arrival-{k}"), ventricle_voxels)

    return analyse
