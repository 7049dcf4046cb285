import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from cohortvox.llm import warczip as W
from cohortvox.sources.workspace import Workspace


def pages():
    big = "é" * 700
    rows = [(k, f"http://h/{k}", big if k % 3 == 0 else f"<p>{k}</p>" * (k * 40)) for k in range(30)]
    rows += [(40, None, None), (41, "u", ""), (42, "u", "x" * 999), (43, "u", "x" * 999), (44, "u\r\nWARC-Type: no", "y" * 1000), (45, "", "y" * 1000)]
    return rows + [(None, "n", big), (50, "dup", "d" * 2000), (50, "dup", "d" * 2000), (51, "q", "\r\n\r\nWARC/1.1\r\n" * 90)]


def brute(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    keep = {}
    for i, b in raw:
        if i is not None and len(b) >= 1000:
            keep[b] = max(keep.get(b, i), i)
    out = []
    for i, b in raw:
        k = keep.get(b)
        visit = i is not None and k is not None and i < k
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", k if visit else None))
    return out


@pytest.mark.parametrize("package", [3000, 1 << 20])
def test_round_trip(spark, package):
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, digest string").repartition(3)
    ws = Workspace(spark, "t")
    folder = ws.path("zip")
    manifest = ws.table(W.write_packages(W.record_plan(df, ws), folder, package), "m")
    assert (manifest.count() > 5) == (package == 3000)
    records = W.read_packages(manifest, folder)
    got = W.resolve_revisits(records, ws).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(pages())))
    texts = {r.page_id: r.payload for r in records.where("record_type = 'response'").collect()}
    assert texts[51] == pages()[-1][2].encode()
    for r in manifest.collect():  # another reader agrees with the packages
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None and set(z.namelist()) == {W.DATA, W.INDEX}
    empty = ws.table(W.write_packages(W.record_plan(df.limit(0), ws), ws.path("zip")), "m")
    assert W.resolve_revisits(W.read_packages(empty, folder), ws).count() == 0


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment " * 40])
def test_reads_other_writers(comment):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a/é.txt", b"hello")
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"world" * 10)
        z.writestr("packed", b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    index = W.ZipIndex(Bytes(buf.getvalue()))
    for name, want in (("a/é.txt", b"hello"), ("big", b"world" * 10)):
        at, n = index.stored(name)
        assert index.read(at, n) == want
    with pytest.raises(ValueError):
        index.stored("packed")
    for raw in (b"", b"PK", buf.getvalue()[:-30]):
        with pytest.raises(ValueError):
            W.ZipIndex(Bytes(raw))


def test_many_members():
    """More members than the short end record can count."""
    out = pa.BufferOutputStream()
    keep = out.getvalue
    z = W.ZipWriter(type("S", (), {"write": out.write, "close": lambda self: None})())
    for k in range(70_000):
        z.begin(f"m{k}")
        z.write(b"%d" % k)
        z.end()
    z.close()
    index = W.ZipIndex(Bytes(keep().to_pybytes()))
    assert len(index.members) == 70_000
    at, n = index.stored("m69999")
    assert index.read(at, n) == b"69999"
