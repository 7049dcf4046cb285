"""Benchmark decontamination by a positional inverted index over the corpus.

``build_index`` writes index segments: each holds the posting lists (positions
in the segment, delta coded) of every term of a bounded run of whole documents.
``search`` intersects offset-adjusted posting lists inside each segment, from
the query's rarest term on, for exact phrases or for terms within a proximity.
A document never leaves its segment, so neither step shuffles.

Cases: null, empty and wordless texts are indexed with no words and match
nothing; repeated rows are indexed once each; items with a null item_id hit words
and count as one item without a name; an empty corpus or query set gives no
matches; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortvox.llm.rownumbers import ids_name_rows, numbered
from cohortvox.llm.textcore import ALNUM, bound_batches, text_chunks, word_hashes
from cohortvox.sources.workspace import Workspace

#: Words after which an index segment is closed (a longer document fills one).
SEGMENT_WORDS = 500_000
#: Query terms broadcast at once (16 bytes each); more queries run in slices.
QUERY_TERMS = 2_000_000
#: Most slices of queries that one pass over the index holds.
QUERY_SLICES = 16
#: Windows of an Arrow batch, and tasks that write slices at most.
WINDOW_ROWS = 8_192
MOST_TASKS = 1_000
#: Contaminated ids (8 bytes each) up to which the stage broadcasts them to the texts.
BROADCAST_ROWS = 500_000
#: Stands for a null item_id.
NO_ID = -(1 << 63)
#: Words of a window, and the share of hit words that marks a document (1 / 20).
WINDOW = 13
SHARE = 20

SEGMENT = (
    "segment string, doc_id array<bigint>, n_words array<int>, terms binary, "
    "counts binary, postings binary"
)


def encode_gaps(gaps: np.ndarray) -> bytes:
    """Unsigned gaps as little-endian base-128 varints."""
    gaps = gaps.astype(np.uint64)
    width = np.ones(len(gaps), np.int64)
    for shift in (7, 14, 21, 28, 35):
        width += gaps >= np.uint64(1 << shift)
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - width
    for k in range(int(width.max()) if len(width) else 0):
        some = width > k
        more = np.where(width[some] > k + 1, 128, 0)
        out[begin[some] + k] = ((gaps[some] >> np.uint64(7 * k)) & np.uint64(127)) | more.astype(np.uint64)
    return out.tobytes()


def decode_gaps(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    last = b < 128
    ends = np.flatnonzero(last)
    begin = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - begin).max()) + 1 if len(ends) else 0):
        some = begin + k <= ends
        out[some] |= (b[begin[some] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _segment(parts: list) -> dict:
    """One segment row from ``(doc_ids, n_words, hashes)`` runs.

    A word's position counts words before it in the segment plus a gap of one
    between documents, so no phrase spans two of them.
    """
    ids = [i for p in parts for i in p[0]]
    n = np.concatenate([p[1] for p in parts])
    h = np.concatenate([p[2] for p in parts])
    pos = np.arange(len(h), dtype=np.int64) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    h, pos = h[order], pos[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    gaps = np.diff(pos, prepend=0)
    gaps[first] = pos[first]
    counts = np.diff(np.r_[first, len(h)]).astype(np.int32)
    name = hashlib.blake2b(h.tobytes() + repr(ids).encode(), digest_size=12).hexdigest()
    return {
        "segment": name, "doc_id": ids, "n_words": n.astype(np.int32).tolist(),
        "terms": h[first].tobytes(), "counts": counts.tobytes(), "postings": encode_gaps(gaps),
    }


def _index(id_col: str, text_col: str, segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("segment", pa.string()), ("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())),
            ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary()),
        ])
        parts, total = [], 0
        for batch in batches:
            ids = batch.column(id_col).to_pylist()
            for i, j, off, data in text_chunks(batch.column(text_col)):
                row, h = word_hashes(data, off, ALNUM)
                parts.append((ids[i:j], np.bincount(row, minlength=j - i), h))
                total += len(h)
                if total >= segment_words:
                    yield pa.RecordBatch.from_pylist([_segment(parts)], schema)
                    parts, total = [], 0
        if parts:
            yield pa.RecordBatch.from_pylist([_segment(parts)], schema)

    return run


def build_index(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text",
                segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Writes the positional index of ``docs`` and returns its segments."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return ws.table(src.mapInArrow(_index(id_col, text_col, segment_words), SEGMENT), "index")


class Postings:
    """One segment's posting lists of some terms, as sorted (term, position) keys."""

    def __init__(self, seg: dict, wanted: np.ndarray):
        terms = np.frombuffer(seg["terms"], np.uint64)
        counts = np.frombuffer(seg["counts"], np.int32).astype(np.int64)
        self.n_words = np.asarray(seg["n_words"], np.int64)
        self.begin = np.r_[0, np.cumsum(self.n_words + 1)]
        pos = np.cumsum(decode_gaps(seg["postings"]))
        first = np.r_[0, np.cumsum(counts)]
        base = np.r_[0, pos[first[1:-1] - 1]] if len(counts) else np.zeros(0, np.int64)
        rank = np.searchsorted(wanted, terms)
        rank[rank == len(wanted)] = 0
        keep = wanted[rank] == terms if len(wanted) else np.zeros(len(terms), bool)
        each = np.repeat(keep, counts)
        ids = np.repeat(rank[keep], counts[keep]).astype(np.int64)
        self.keys = (ids << 34) | (pos - np.repeat(base, counts))[each]
        self._size = np.zeros(len(wanted), np.int64)
        self._size[rank[keep]] = counts[keep]

    def size(self, term: np.ndarray) -> np.ndarray:
        return self._size[term]

    def positions(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which of term, position)`` of all their postings."""
        a = np.searchsorted(self.keys, term << 34)
        n = self._size[term]
        which = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return which, self.keys[at] & ((1 << 34) - 1)

    def has(self, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(pos), bool)
        k = (term << 34) | pos
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return (pos >= 0) & (self.keys[i] == k)

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a posting of ``term`` lies from ``low`` to ``high``."""
        if not len(self.keys):
            return np.zeros(len(low), bool)
        i = np.searchsorted(self.keys, (term << 34) | np.maximum(low, 0))
        j = np.minimum(i, len(self.keys) - 1)
        return (i < len(self.keys)) & (self.keys[j] <= ((term << 34) | np.maximum(high, 0))) & (high >= 0)


class Queries:
    """Phrases as terms in rarest-first order with their offsets; ``counts`` follows the sorted distinct terms."""

    def __init__(self, item: np.ndarray, phrases: list[np.ndarray], counts: np.ndarray):
        self.item, self.length = item, np.asarray([len(p) for p in phrases], np.int64)
        flat = np.concatenate(phrases) if phrases else np.zeros(0, np.uint64)
        self.terms, inv = np.unique(flat, return_inverse=True)
        most = int(self.length.max()) if len(phrases) else 0
        self.term = np.full((len(phrases), most), -1, np.int64)
        self.offset = np.zeros((len(phrases), most), np.int64)
        at = 0
        for q, p in enumerate(phrases):
            t = inv[at : at + len(p)]
            at += len(p)
            order = np.argsort(counts[t], kind="stable")
            self.term[q, : len(p)], self.offset[q, : len(p)] = t[order], order

    def exact(self, post: Postings) -> tuple[np.ndarray, np.ndarray]:
        """``(query, position of its first word)`` of every exact occurrence."""
        live = np.flatnonzero(self.length > 0)
        for r in range(self.term.shape[1]):  # a term without postings rules the query out
            t = self.term[live, r]
            live = live[(t < 0) | (post.size(np.maximum(t, 0)) > 0)]
        if not len(live):
            return live, live
        which, pos = post.positions(self.term[live, 0])
        q, start = live[which], pos - self.offset[live[which], 0]
        for r in range(1, self.term.shape[1]):
            t = self.term[q, r]
            ok = (t < 0) | post.has(np.maximum(t, 0), start + self.offset[q, r])
            q, start = q[ok], start[ok]
        return q, start

    def proximity(self, post: Postings, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, position)`` where every term is within ``slack`` of its place."""
        live = np.flatnonzero(self.length > 0)
        if not len(live):
            return live, live
        which, pos = post.positions(self.term[live, 0])
        q, start = live[which], pos - self.offset[live[which], 0]
        doc = np.searchsorted(post.begin, pos, "right") - 1
        low, high = post.begin[doc], post.begin[doc + 1] - 2  # the document's first and last position
        for r in range(1, self.term.shape[1]):
            t, at = self.term[q, r], start + self.offset[q, r]
            ok = (t < 0) | post.near(np.maximum(t, 0), np.maximum(at - slack, low), np.minimum(at + slack, high))
            q, start, low, high = q[ok], start[ok], low[ok], high[ok]
        return q, np.maximum(start, low)


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_numpy()
            for i, j, off, data in text_chunks(batch.column("text")):
                row, h = word_hashes(data, off, ALNUM)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                n = np.diff(cut)
                m = np.where(n > 0, np.maximum(1, n - size + 1), 0)
                first = np.repeat(cut[:-1] - np.cumsum(m) + m, m) + np.arange(m.sum())
                length, item = np.repeat(np.minimum(n, size), m), np.repeat(ids[i:j], m)
                for k in range(0, len(first), WINDOW_ROWS):
                    some = slice(k, k + WINDOW_ROWS)
                    ends = np.cumsum(length[some])
                    at = np.repeat(first[some] - ends + length[some], length[some]) + np.arange(ends[-1])
                    offsets = np.r_[0, 8 * ends].astype(np.int32)
                    phrase = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(h[at])])
                    yield pa.RecordBatch.from_arrays([pa.array(item[some]), phrase], ["item_id", "phrase"])

    return run


def query_slices(items: DataFrame, ws: Workspace, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text",
                 slice_terms: int = QUERY_TERMS) -> list[DataFrame]:
    """Written slices ``(item_id, phrase)`` of all distinct windows of the items' words.

    A window's slice is its hash, so slices hold about ``slice_terms`` terms each
    whatever an item's length.
    """
    src = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("item_id"), F.col(text_col).alias("text"))
    found = ws.table(src.mapInArrow(_windows(size), "item_id bigint, phrase binary").distinct(), "windows")
    terms = found.agg(F.sum(F.octet_length("phrase") / 8)).first()[0]
    if not terms:
        return []
    n = int(-(-terms // slice_terms))
    if n == 1:
        return [found]
    path = ws.path("slices")
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("item_id", "phrase"), F.lit(n)))
    sliced.repartition(min(n, MOST_TASKS), "slice").write.partitionBy("slice").parquet(path)
    ws.drop(found)
    spark = items.sparkSession
    ids = sorted(r.slice for r in spark.read.parquet(path).select("slice").distinct().collect())
    return [spark.read.schema("item_id bigint, phrase binary").parquet(f"{path}/slice={k}") for k in ids]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences in the whole index of the given sorted terms (about QUERY_TERMS at most)."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            for seg in _segments([batch]):
                t = np.frombuffer(seg["terms"], np.uint64)
                some = np.isin(t, wanted.value)
                n = np.frombuffer(seg["counts"], np.int32)[some].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t[some].view(np.int64)), pa.array(n)], ["term", "n"])

    found = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    wanted.destroy()
    out = np.zeros(len(terms), np.int64)
    out[np.searchsorted(terms, found.column("term").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    return out


MATCH = "segment string, item_id bigint, doc bigint, doc_id bigint, start bigint, length bigint"


def search(index: DataFrame, item: np.ndarray, phrases: list[np.ndarray], slack: int | None = None) -> DataFrame:
    """Matches of the phrases: exact, or with every word within ``slack`` of its place.

    One row per occurrence: the item, the document (``doc`` is its number in the
    segment) and the first word's index in the document.
    """
    spark = index.sparkSession
    q = Queries(item, phrases, term_counts(index, np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)))
    shared = spark.sparkContext.broadcast(q)

    def run(batches):
        qs = shared.value
        for seg in _segments(batches):
            post = Postings(seg, qs.terms)
            hit, start = qs.exact(post) if slack is None else qs.proximity(post, slack)
            doc = np.searchsorted(post.begin, np.maximum(start, 0), "right") - 1
            ids = np.asarray([x if x is not None else -1 for x in seg["doc_id"]], np.int64)
            null = np.asarray([x is None for x in seg["doc_id"]], bool)
            yield pa.RecordBatch.from_arrays([
                pa.array([seg["segment"]] * len(hit), pa.string()), pa.array(qs.item[hit]), pa.array(doc),
                pa.array(ids[doc], mask=null[doc]), pa.array(start - post.begin[doc]), pa.array(qs.length[hit]),
            ], ["segment", "item_id", "doc", "doc_id", "start", "length"])

    return index.mapInArrow(run, MATCH)


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<bigint>"


def _cover(seg: dict, found: list) -> dict:
    """Per document of one segment: words hit by any occurrence, and the items."""
    n = np.asarray(seg["n_words"], np.int64)
    begin = np.r_[0, np.cumsum(n + 1)]
    start = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    length = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
    item = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    edge = np.bincount(start, minlength=begin[-1] + 1) - np.bincount(start + length, minlength=begin[-1] + 1)
    hit = np.r_[0, np.cumsum(np.cumsum(edge) > 0)]
    n_hit = hit[begin[1:]] - hit[begin[:-1]]
    doc = np.searchsorted(begin, start, "right") - 1
    pairs = np.unique(np.stack([doc, item]), axis=1)
    items: list[list[int]] = [[] for _ in n]
    for d, i in pairs.T.tolist():
        items[d].append(i)
    return {"doc_id": seg["doc_id"], "n_words": n, "n_hit": n_hit, "items": items}


def _shared(index: DataFrame, slices: list[DataFrame]) -> list:
    """The slices as broadcast queries; the driver holds one at a time."""
    out = []
    for part in slices:
        t = part.toArrow()
        phrases = [np.frombuffer(p, np.uint64) for p in t.column("phrase").to_pylist()]
        counts = term_counts(index, np.unique(np.concatenate(phrases)))
        out.append(index.sparkSession.sparkContext.broadcast(Queries(t.column("item_id").to_numpy(), phrases, counts)))
    return out


def _found(seg: dict, shared: list) -> list:
    """``(items, first words, lengths)`` of one segment's occurrences by slice."""
    found = []
    for b in shared:
        qs = b.value
        q, start = qs.exact(Postings(seg, qs.terms))
        found.append((qs.item[q], start, qs.length[q]))
    return found


FOUND = "segment string, doc bigint, start bigint, length bigint, item_id bigint"


def _matches(index: DataFrame, shared: list) -> DataFrame:
    """One pass over the index: rows with the distinct occurrences, and rows with the distinct items, of each document."""

    def run(batches):
        for seg in _segments(batches):
            n = np.asarray(seg["n_words"], np.int64)
            begin = np.r_[0, np.cumsum(n + 1)]
            item, start, length = (np.concatenate(x) for x in zip(*_found(seg, shared), strict=True))
            doc = np.searchsorted(begin, start, "right") - 1
            at = np.unique(np.stack([doc, start - begin[doc], length]), axis=1)
            has = np.unique(np.stack([doc, item]), axis=1)
            a, h = at.shape[1], has.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array([seg["segment"]] * (a + h), pa.string()), pa.array(np.r_[at[0], has[0]]),
                pa.array(np.r_[at[1], np.zeros(h, np.int64)], mask=np.arange(a + h) >= a),
                pa.array(np.r_[at[2], np.zeros(h, np.int64)], mask=np.arange(a + h) >= a),
                pa.array(np.r_[np.zeros(a, np.int64), has[1]], mask=np.arange(a + h) < a),
            ], ["segment", "doc", "start", "length", "item_id"])

    return index.mapInArrow(run, FOUND)


def _fold(index: DataFrame, matches: DataFrame, share: int) -> DataFrame:
    """The report from the matches of all passes.

    Equal segments have equal names and equal matches, so matches count once a
    name and join to every segment of that name.
    """
    key = ["segment", "doc"]
    at = matches.where("start is not null").groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start")))
    hit = at.withColumn("new", F.greatest(new, F.lit(0))).groupBy(*key).agg(F.sum("new").alias("hit"))
    has = matches.where("item_id is not null").groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("doc", "d")).select("segment", F.col("doc").cast("long").alias("doc"), "d.*")
    n_hit, items = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<bigint>"))
    names = F.concat_ws(",", F.sort_array(F.transform(F.filter(items, lambda i: i != NO_ID), lambda i: i.cast("string"))))
    return docs.join(hit, key, "left").join(has, key, "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.transform(items, lambda i: F.nullif(i, F.lit(NO_ID))).alias("items"),
    )


def contamination(docs: DataFrame, items: DataFrame, ws: Workspace, window: int = WINDOW, share: int = SHARE,
                  slice_terms: int = QUERY_TERMS) -> DataFrame:
    """Per document, the words inside occurrences of the items' windows.

    A document is contaminated if it has hit words and they are at least one in
    ``share`` of its words.  ``items`` lists the items found.  More than
    QUERY_SLICES slices take several passes, whose matches are written and folded.
    """
    index = build_index(docs, ws)
    slices = query_slices(items, ws, window, slice_terms=slice_terms)
    if len(slices) > QUERY_SLICES:
        path = ws.path("matches")
        for k in range(0, len(slices), QUERY_SLICES):
            shared = _shared(index, slices[k : k + QUERY_SLICES])
            _matches(index, shared).write.mode("append").parquet(path)
            for b in shared:
                b.destroy()
        return _fold(index, docs.sparkSession.read.schema(FOUND).parquet(path), share)
    shared = _shared(index, slices)

    def run(batches):
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
            ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64())),
        ])
        for seg in _segments(batches):
            c = _cover(seg, _found(seg, shared))
            names = [sorted(str(i) for i in x if i != NO_ID) for x in c["items"]]
            yield pa.RecordBatch.from_arrays([
                pa.array(c["doc_id"], pa.int64()), pa.array(c["n_words"]), pa.array(c["n_hit"]),
                pa.array([len(x) for x in c["items"]], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                pa.array((c["n_hit"] > 0) & (share * c["n_hit"] >= c["n_words"])),
                pa.array([[None if i == NO_ID else i for i in x] for x in c["items"]], pa.list_(pa.int64())),
            ], schema=schema)

    return index.select("doc_id", "n_words", "terms", "counts", "postings").mapInArrow(run, REPORT)


def op4_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items, Workspace(spark, "op4")).drop("items")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes contaminated rows; all others stay, those with null ids or texts included.

    Where ids are null or repeat, rows are numbered, so each is judged by its own text.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ws = Workspace(spark, "decontaminate")
    if not ids_name_rows(docs):
        rows = numbered(docs, ws)
        bad = contamination(rows.select("doc_id", "text"), items, ws).where("contaminated").select(F.col("doc_id").alias("__bad"))
        bad = ws.table(bad, "bad")
        return rows.join(bad, rows["doc_id"] == bad["__bad"], "left_anti").select("row.*")
    bad = contamination(docs, items, ws).where("contaminated").select(F.col("doc_id").alias("__bad"))
    bad = ws.keep(bad, "bad", BROADCAST_ROWS)
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
