"""Volume files (gzip or plain NIfTI-1) as a Spark data source, and their voxel and geometry tables.

The source ``volume_planes`` gives one row per z-plane of a file.  A plain file
is read in slab ranges by several tasks, a compressed one by one task that
decodes it as a stream and holds a plane at a time; either way each byte is read
once.  Asked for headers, it reads no further than the header.  Files are opened
through Arrow's file systems, so folders may lie in any store that these know.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortvox.sources.manifest import manifest

HEADER = 348
#: Files that a case's voxels are written to at most.
SPREAD = 4
#: Bytes of a plain file that a task reads at least, and headers that a task reads.
SLAB_BYTES = 32 << 20
HEADERS = 64
#: NIfTI datatype codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def _chunks(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed pieces of a stream read once from its start; a compressed one may have several members."""
    part = stream.read(size)
    if part[:2] != b"\x1f\x8b":
        while part:
            yield part
            part = stream.read(size)
        return
    z = zlib.decompressobj(31)
    while part:
        if z.eof:
            if not part.strip(b"\0"):  # padding after the last member
                part = stream.read(size)
                continue
            z = zlib.decompressobj(31)
        yield z.decompress(part, size)  # at most ``size`` bytes at once
        part = z.unconsumed_tail or z.unused_data or stream.read(size)
    yield z.flush()


class Reader:
    """Takes exact byte counts from a stream (or bytes), decompressed where it is."""

    def __init__(self, stream):
        self.chunks, self.held = _chunks(io.BytesIO(stream) if isinstance(stream, bytes) else stream), b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            c = next(self.chunks, None)
            if c is None:
                raise ValueError("a truncated volume")
            parts.append(c)
            have += len(c)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def parse_header(h: bytes) -> dict:
    """Shape, spacing, type, scaling and description of a 348-byte header of either byte order."""
    for order in "<>":
        if struct.unpack(order + "i", h[:4])[0] == HEADER:
            break
    else:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack(order + "8h", h[40:56])
    zoom = struct.unpack(order + "8f", h[76:108])
    code = struct.unpack(order + "h", h[70:72])[0]
    offset, slope, inter = struct.unpack(order + "3f", h[108:120])
    if code not in TYPES:
        raise ValueError(f"datatype {code}")
    shape = [max(1, dim[k]) if k <= dim[0] else 1 for k in (1, 2, 3)]
    return {
        "shape": shape, "spacing": [abs(z) or 1.0 for z in zoom[1:4]], "dtype": order + TYPES[code], "offset": int(offset) or 352,
        "slope": slope if slope not in (0.0,) and np.isfinite(slope) else 1.0, "inter": inter if np.isfinite(inter) else 0.0,
        "description": h[148:228].split(b"\0")[0].decode("latin-1"),
    }


VOLUME = "path string, nx int, ny int, nz int, dx double, dy double, dz double, description string"
PLANE = "path string, nx int, ny int, nz int, z int, plane array<double>"
_ARROW = {"path": pa.string(), "description": pa.string(), "plane": pa.list_(pa.float64()), **dict.fromkeys(("nx", "ny", "nz", "z"), pa.int32()), **dict.fromkeys(("dx", "dy", "dz"), pa.float64())}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there; Spark writes local paths with one slash."""
    path = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Slab(InputPartition):
    """Files whose headers are wanted, or the part-th of ``parts`` ranges of planes of one file."""

    def __init__(self, paths: list[str], part: int = 0, parts: int = 1):
        self.paths, self.part, self.parts = paths, part, parts


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.headers = options.get("headers", "false") == "true"
        self.slab = int(options.get("slabbytes", SLAB_BYTES))
        self.files, self.root = options.get("files"), options.get("path")
        self.schema = pa.schema([(c, _ARROW[c]) for c in columns])

    def _listed(self) -> list[tuple[str, int]]:
        """``(path, bytes)`` of the files named, or of all volume files below the root."""
        if self.files is not None:
            out = []
            for p in json.loads(self.files):
                system, name = _open(p)
                out.append((p, system.get_file_info(name).size))
            return out
        system, name = _open(self.root)
        found = system.get_file_info(fs.FileSelector(name, recursive=True))
        scheme = re.match("(?!file:)[a-z0-9]+://", self.root)
        prefix = scheme[0] if scheme else "file:"
        return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and ".nii" in f.base_name)

    def partitions(self) -> list[Slab]:
        files = self._listed()
        if self.headers:
            return [Slab([p for p, _ in files[k : k + HEADERS]]) for k in range(0, len(files), HEADERS)]
        parts = [(p, 1 if p.endswith(".gz") else max(1, -(-n // self.slab))) for p, n in files]
        return [Slab([p], k, n) for p, n in parts for k in range(n)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        for path in partition.paths if partition else []:
            system, name = _open(path)
            with system.open_input_stream(name, compression=None) as stream:
                if self.headers:
                    h = parse_header(Reader(stream).take(HEADER))
                    row = {"path": path, **dict(zip(("nx", "ny", "nz"), h["shape"])), **dict(zip(("dx", "dy", "dz"), map(float, h["spacing"]))), "description": h["description"]}
                    yield pa.RecordBatch.from_pylist([row], self.schema)
                else:
                    yield from self._planes(path, system, name, stream, partition)

    def _planes(self, path: str, system, name: str, stream, partition: Slab) -> Iterator[pa.RecordBatch]:
        r = Reader(stream)
        h = parse_header(r.take(HEADER))
        nx, ny, nz = h["shape"]
        kind = np.dtype(h["dtype"])
        z0, z1 = (nz * k // partition.parts for k in (partition.part, partition.part + 1))
        size = nx * ny * kind.itemsize
        if z0:  # a plain file: on from the first plane of the range
            whole = system.open_input_file(name)
            whole.seek(h["offset"] + z0 * size)
            r = Reader(whole)
        else:
            r.take(h["offset"] - HEADER)
        for z in range(z0, z1):
            v = np.frombuffer(r.take(size), kind).astype(float) * h["slope"] + h["inter"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), *[pa.array([n], pa.int32()) for n in (nx, ny, nz, z)], pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], schema=self.schema)


class VolumePlanes(DataSource):
    """Options: ``path`` (a folder) or ``files`` (a JSON list), ``headers`` (true for one row per file), ``slabBytes``."""

    @classmethod
    def name(cls) -> str:
        return "volume_planes"

    def _ddl(self) -> str:
        return VOLUME if self.options.get("headers", "false") == "true" else PLANE

    def schema(self) -> str:
        return self._ddl()

    def reader(self, schema) -> VolumeReader:
        return VolumeReader({k.lower(): v for k, v in self.options.items()}, [c.split()[0] for c in self._ddl().split(", ")])


def _load(spark: SparkSession, source: str | list[str], headers: bool, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    spark.dataSource.register(VolumePlanes)
    r = spark.read.format("volume_planes").option("headers", str(headers).lower()).option("slabBytes", str(slab_bytes))
    return r.option("files", json.dumps(source)).load() if isinstance(source, list) else r.load(source)


def read_geometry(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Shape, spacing and description of every file, from its header alone."""
    return _load(spark, source, True)


def read_planes(spark: SparkSession, source: str | list[str], slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """``(path, nx, ny, nz, z, plane)``: one row per z-plane, x running fastest."""
    return _load(spark, source, False, slab_bytes)


def read_voxels(spark: SparkSession, source: str | list[str], keep_zero: bool = False) -> DataFrame:
    """``(path, x, y, z, value)`` of every file; zeros (background) are left out unless asked for."""
    v = read_planes(spark, source).select("path", "nx", "z", F.posexplode("plane").alias("at", "value"))
    v = v.select("path", F.expr("at % nx").cast("long").alias("x"), F.expr("at div nx").alias("y"), F.col("z").cast("long").alias("z"), "value")
    return v if keep_zero else v.where("value <> 0")


def wide_voxels(planes: DataFrame) -> DataFrame:
    """One row per voxel with any signal: the sequences of a case side by side, labels rounded half to even.

    Whole planes are shuffled, not voxels: a row per file and slice, whose
    planes are zipped.  Of several files of one sequence the older naming wins,
    then the lesser path.  Sequences of unequal shape are an error.
    """
    seqs = ("t1", "t1ce", "t2", "flair", "seg")
    m = manifest(planes, "nx", "ny", "z", "plane").where("seq is not null").withColumn("spread", F.pmod("z", F.lit(SPREAD)))
    pick = lambda s: F.min_by("plane", F.when(F.col("seq") == s, F.struct(F.col("naming") != "older", "path")))
    shape = F.when((F.min("nx") != F.max("nx")) | (F.min("ny") != F.max("ny")), F.raise_error(F.lit("sequences of a case differ in shape"))).otherwise(F.max("nx"))
    g = m.repartition("case_id", "spread").groupBy("case_id", "spread", "z").agg(shape.alias("nx"), *[pick(s).alias(s) for s in seqs])
    v = g.select("case_id", "nx", "z", F.posexplode(F.arrays_zip(*[F.coalesce(s, F.array().cast("array<double>")).alias(s) for s in seqs])).alias("at", "v"))
    value = {s: F.coalesce(F.col("v")[s], F.lit(0.0)) for s in seqs}
    some = value["seg"] != 0
    for s in seqs[:-1]:
        some |= value[s] != 0
    return v.where(some).select(
        "case_id", F.expr("at % nx").cast("long").alias("x"), F.expr("at div nx").alias("y"), F.col("z").cast("long").alias("z"),
        *[value[s].alias(s) for s in seqs[:-1]], F.bround(value["seg"]).cast("int").alias("seg"),
    )


def case_geometry(headers: DataFrame) -> DataFrame:
    """The geometry of each case: of its T1 file where it has one, else of another sequence before its labels."""
    geo = manifest(headers, "nx", "ny", "nz", "dx", "dy", "dz", "description").where("seq is not null")
    first = geo.groupBy("case_id").agg(F.min_by(F.struct("nx", "ny", "nz", "dx", "dy", "dz", "description"), F.struct(F.col("seq") != "t1", F.col("seq") == "seg", "path")).alias("g"))
    return first.select("case_id", "g.*")


def ingest(spark: SparkSession, source: str | list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """Writes wide voxels (partitioned by case) and volumes of a folder or of listed files; returns ``(voxels, volumes)`` as read back."""
    wide_voxels(read_planes(spark, source)).write.mode("overwrite").partitionBy("case_id").parquet(f"{out}/voxels")
    case_geometry(read_geometry(spark, source)).write.mode("overwrite").parquet(f"{out}/volumes")
    return spark.read.parquet(f"{out}/voxels"), spark.read.parquet(f"{out}/volumes")
