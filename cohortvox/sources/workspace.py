"""Intermediate tables in the folder that the driver and all executors share.

A cluster names that folder in ``spark.checkpoint.dir``.  Only where the setting
is absent (local tests) a temporary folder of this machine is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder's URI, as configured; a local one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="cohortvox-")
    return _LOCAL[app]


def input_state(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below some paths: names, sizes and modification times; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    n, mark = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return f"{n}-{mark}"


#: Tables kept for an application: (application, name) -> (state of the inputs, folder).
_STORED: dict[tuple[str, str], tuple[str, str]] = {}


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None], last: str = "") -> str:
    """The folder that ``build(folder)`` filled for these inputs; built again when a file below them has changed.

    ``last`` names the table in it that is written last, as ``/done``.
    """
    key, state = (spark.sparkContext.applicationId, f"{name}|{'|'.join(inputs)}"), input_state(spark, *inputs)
    ws = Workspace(spark, name)
    if key in _STORED:
        known, folder = _STORED[key]
        if known == state and ws.exists(folder + last):
            return folder
        ws.delete(folder)
    folder = ws.path(name)
    build(folder)
    if not ws.exists(folder + last):
        raise RuntimeError(f"{name} was not written")
    _STORED[key] = (state, folder)
    return folder


def forget(spark: SparkSession, name: str) -> None:
    """Deletes what ``stored`` keeps under a name in this application."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId and k[1].split("|")[0] == name]:
        Workspace(spark, name).delete(_STORED.pop(key)[1])


class Workspace:
    """Tables of one operator run, written as Parquet and read again.

    Writing cuts the lineage, so a lost executor costs a re-read instead of a
    recomputation, and a table's partition ids stay as they were written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        self._paths.append(f"{self.root}/{self._n:03d}-{name}")
        return self._paths[-1]

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            self.delete(getattr(t, "workspace_path", None))

    def keep(self, df: DataFrame, name: str = "kept", broadcast_rows: int = 0) -> DataFrame:
        """Writes ``df`` as the run's only table: all others are deleted.

        With ``broadcast_rows``, a table of at most that many rows is marked for
        broadcast; a larger one is left to a shuffle.
        """
        out = self.table(df, name)
        for p in self._paths:
            if p != out.workspace_path:
                self.delete(p)
        self._paths = [out.workspace_path]
        return F.broadcast(out) if broadcast_rows and out.count() <= broadcast_rows else out

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        """Whether a table was written there as a whole."""
        files, p = self._at(f"{path}/_SUCCESS")
        return files.exists(p)

    def delete(self, path: str | None) -> None:
        if path:
            files, p = self._at(path)
            files.delete(p, True)
