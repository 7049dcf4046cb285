"""WARC records in ZIP packages, written and read by range.

Writing: payload digests decide which record keeps its payload and which become
revisits; each task then packs its records into ZIP files of bounded size in the
shared folder.  A package holds ``archive/data.warc.gz`` (one gzip member per
record) and ``indexes/index.cdx`` (one JSON line per record), both stored, that
is uncompressed in the package.  Records pass straight through to the file; only
the index lines of one package are held.

Reading: a package's end record, its ZIP64 locator and end record where there
are any, and the central directory are parsed from the file's tail; stored
members are located by their local headers; index and records are then read by
range from inside the package.  Nothing is extracted.

Files are reached through Arrow's file systems, so the shared folder may be a
local path or any store that Arrow knows by URI.  A retried or duplicated task
writes packages of its own names; only those in the committed manifest are read.

Cases: a null html is an empty payload; a null url is empty; rows with a null
page_id are responses (an id is what a revisit refers to); of repeated rows with
one page_id and payload all are responses if the payload is theirs to keep;
empty tables give no packages; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib


import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.textcore import bound_batches
from cohortvox.operators.hotjoin import join_classes
from cohortvox.sources.workspace import Workspace

#: Payloads from this size on are stored once.
LEAST_BYTES = 1_000
#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 64 << 20
#: Bytes read from a package's end to find its directory.
TAIL = 66_000

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")
_END64 = struct.Struct("<4sQHHIIQQQQ")
_LOCATOR = struct.Struct("<4sIQI")
_BIG = 0xFFFFFFFF


def open_store(uri: str):
    """``(file system, path)`` of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ZipWriter:
    """Stored members written one after another to a stream that cannot seek.

    Sizes and checksum follow each member in a ZIP64 data descriptor.
    """

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.entry = {"name": raw, "offset": self.at, "crc": 0, "size": 0}
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # sizes are 64 bits in the descriptor
        self._write(_LOCAL.pack(b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, _BIG, _BIG, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Appends to the member; returns where in the member it begins."""
        at = self.entry["size"]
        self.entry["crc"] = zlib.crc32(data, self.entry["crc"])
        self.entry["size"] += len(data)
        self._write(data)
        return at

    def end(self) -> None:
        e = self.entry
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", e["crc"], e["size"], e["size"]))
        self.entries.append(e)

    def close(self) -> None:
        start = self.at
        for e in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, e["size"], e["size"], e["offset"])
            self._write(_CENTRAL.pack(b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, e["crc"], _BIG, _BIG, len(e["name"]), len(extra), 0, 0, 0, 0, _BIG) + e["name"] + extra)
        size, n = self.at - start, len(self.entries)
        end64 = self.at
        self._write(_END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        self._write(_LOCATOR.pack(b"PK\x06\x07", 0, end64, 1))
        self._write(_END.pack(b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _BIG), _BIG, 0))
        self.out.close()


class ZipIndex:
    """The members of a package: name to (method, size, data offset)."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - TAIL)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + _END.size + self._comment(tail, end) != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark inside a comment
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, size, start, _ = _END.unpack_from(tail, end)
        where = tail_at + end
        if _BIG in (size, start) or n == 0xFFFF:
            if where >= _LOCATOR.size:
                mark, _, at64, _ = _LOCATOR.unpack(self.read(where - _LOCATOR.size, _LOCATOR.size))
                if mark == b"PK\x06\x07":
                    mark, _, _, _, _, _, _, n, size, start = _END64.unpack(self.read(at64, _END64.size))
                    if mark != b"PK\x06\x06":
                        raise ValueError("no ZIP64 end of central directory")
        self.members = self._directory(self.read(start, size), n)

    @staticmethod
    def _comment(tail: bytes, end: int) -> int:
        return struct.unpack_from("<H", tail, end + 20)[0] if end + _END.size <= len(tail) else -1

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.size:
            raise ValueError("a range outside the file")
        return self.file.read_at(size, at)

    def _directory(self, raw: bytes, n: int) -> dict[str, tuple[int, int, int]]:
        out, at = {}, 0
        for _ in range(n):
            mark, _, _, flags, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, offset = _CENTRAL.unpack_from(raw, at)
            if mark != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            at += _CENTRAL.size
            name, extra = raw[at : at + n_name], raw[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            size, packed, offset = self._wide(extra, size, packed, offset)
            out[name.decode("utf-8" if flags & 0x800 else "cp437")] = (method, packed, offset)
        return out

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
        """Replaces full 32-bit fields by those of the ZIP64 extra field, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                size, packed, offset = (next(values) if x == _BIG else x for x in (size, packed, offset))
            at += 4 + n
        return size, packed, offset

    def stored(self, name: str) -> tuple[int, int]:
        """``(offset of the member's bytes, size)``; the member must be stored."""
        method, size, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed in the package")
        mark, *_, n_name, n_extra = _LOCAL.unpack(self.read(offset, _LOCAL.size))
        if mark != b"PK\x03\x04":
            raise ValueError("no local header")
        return offset + _LOCAL.size + n_name + n_extra, size


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def warc_record(page: int | None, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A response with its payload, or a revisit with the id it refers to and no payload."""
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in (y if ": " in y else y + " " for y in lines[1:]))
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return fields, rest[:n]


def record_plan(pages: DataFrame, ws: Workspace, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` with ``digest`` and ``refers_to``.

    Digests are found on the pages; only (page_id, digest) rows meet by digest,
    and the revisits they give meet the pages again by page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    small = ws.table(src.where(F.octet_length("html") >= least).where("page_id is not null").select("page_id", "digest"), "digests")
    shared = ws.table(small.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1"), "shared")
    revisits = join_classes(small, shared, ["digest"], "n", small.count(), "inner").where("page_id < keeper").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "keeper").distinct()
    revisits = ws.table(revisits, "revisits")
    on = (src["page_id"] == revisits["__page"]) & (src["digest"] == revisits["__digest"])
    return src.join(revisits, on, "left").select("page_id", "url", "html", "digest", F.col("keeper").alias("refers_to"))


MANIFEST = "path string, records bigint, bytes bigint"


def write_packages(plan: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packs each partition's records; one manifest row per package."""

    def run(batches):
        store, base = open_store(folder)
        made: list[tuple[str, int, int]] = []
        z = None
        lines: list[bytes] = []

        def close():
            z.end()
            z.begin(INDEX)
            for line in lines:
                z.write(line)
            z.end()
            z.close()
            made.append((path, len(lines), z.at))

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if z is None:
                    store.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    z, lines = ZipWriter(store.open_output_stream(path)), []
                    z.begin(DATA)
                raw = _gzip(warc_record(page, url, html.encode(), digest, refers))
                at = z.write(raw)
                lines.append((json.dumps({"page": page, "offset": at, "length": len(raw)}) + "\n").encode())
                if z.at >= package_bytes:
                    close()
                    z = None
        if z is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    bound_batches(plan.sparkSession)
    return plan.mapInArrow(run, MANIFEST)


RECORDS = "page_id bigint, url string, payload binary, payload_digest string, record_type string, refers_to bigint"


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_packages(manifest: DataFrame, folder: str, at_once: int = 8 << 20) -> DataFrame:
    """The records of the listed packages, read by range and verified.

    A response's payload must have the digest that its header states.
    """

    def run(batches):
        store, _ = open_store(folder)
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as f:
                    index = ZipIndex(f)
                    begin, size = index.stored(DATA)
                    at, n = index.stored(INDEX)
                    rows, held = [], 0
                    for line in index.read(at, n).splitlines():
                        e = json.loads(line)
                        if e["offset"] + e["length"] > size:
                            raise ValueError("an index entry outside the archive")
                        fields, payload = parse_record(zlib.decompress(index.read(begin + e["offset"], e["length"]), 31))
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("a payload with another digest than it says")
                        refers = _id(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload if kind == "response" else None, digest, kind, refers))
                        held += len(payload)
                        if held >= at_once or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return manifest.select("path").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, RECORDS)


def resolve_revisits(records: DataFrame, ws: Workspace) -> DataFrame:
    """Per record the size of its full payload; a revisit's is that of the response it refers to."""
    small = records.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    small = ws.table(small, "records")
    revisit = F.col("record_type") == "revisit"
    sizes = small.groupBy("payload_digest").agg(F.max(F.when(~revisit, F.col("payload_bytes"))).alias("size"), F.count_if(revisit).alias("n")).where("n > 0")
    need = small.where(revisit).drop("payload_bytes")
    found = join_classes(need, ws.table(sizes, "sizes"), ["payload_digest"], "n", need.count()).select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return small.where("record_type = 'response'").unionByName(found)


def op3_zip_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op3")
    folder = ws.path("packages")
    plan = record_plan(spark.read.parquet(f"{sf_dir}/pages.parquet"), ws)
    manifest = ws.table(write_packages(plan, folder), "manifest")
    out = resolve_revisits(read_packages(manifest, folder), ws)
    ws.delete(folder)
    return out


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM k
"""
