"""Byte-level text helpers for Arrow batches: word spans and 64-bit word hashes.

All work is NumPy on the text buffer of an Arrow column, so a batch costs a few
passes over its bytes and makes no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries are about 60 times that.  A longer text is cut where no word goes on.
CHUNK_BYTES = 1 << 18

#: Rows of an Arrow batch; both sides of the pipe hold a few batches of whole texts.
BATCH_ROWS = 512


def bound_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size for operators that pass whole texts to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: ASCII digits and letters and every byte of a code point beyond ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but the space and the controls from tab to carriage return.
NONSPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            _POWERS[:] = [
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, f, np.uint64)])
                for f in (_MULT, _INV)
            ]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits (Stafford's variant 13)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial hashes of any byte spans of one buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        p, self._inv = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self._sum = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * p[: len(data)], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self._sum[end] - self._sum[start]) * self._inv[start]
            return mix(h + (end - start).astype(np.uint64))


def hash_bytes(words: list[bytes]) -> np.ndarray:
    """The hashes that PrefixHash gives to these byte strings."""
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    return PrefixHash(data).spans(np.r_[0, ends[:-1]], ends)


def text_chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts of about ``most`` bytes.

    Yields ``(first row, end row, offsets from 0, bytes)``.  A text longer than
    ``most`` is a run of its own; null texts are empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        kind, wide = np.int64, pa.large_string()
    else:
        kind, wide = np.int32, pa.string()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(wide)
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """``(start, end, row)`` of the maximal runs of ``table`` bytes within each text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    prev = np.empty_like(inside)
    prev[0], prev[1:] = False, inside[:-1]
    prev[off[:-1][off[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~prev)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_runs(data: np.ndarray, off: np.ndarray, table: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bytes, offsets)`` of a run of texts; one long text comes in pieces of about ``most`` bytes.

    Pieces begin at a byte outside ``table``, so no word is cut; a word longer than ``most`` makes a longer piece.
    """
    if len(off) != 2 or len(data) <= most:
        yield data, off
        return
    a = 0
    while a < len(data):
        b = min(a + most, len(data))
        while b < len(data) and table[data[b]]:
            outside = np.flatnonzero(~table[data[b : b + most]])
            b = b + int(outside[0]) if len(outside) else min(b + most, len(data))
        yield data[a:b], np.array([0, b - a])
        a = b


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray, most: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the words of a run in order, hashed with A-Z in lower case."""
    rows, hashes = [], []
    for part, ends in word_runs(data, off, table, most):
        start, end, row = word_spans(part, ends, table)
        rows.append(row)
        hashes.append(PrefixHash(LOWER[part]).spans(start, end))
    return np.concatenate(rows), np.concatenate(hashes)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``key`` from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        values = k.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held)
