"""Cross-tokenizer alignment by merging the token ends of two tokenizers.

Both tokenizers' ends are sorted byte offsets of one text.  Diagonals of the
merge are found by binary search (merge path, Green, Odeh and Birk 2014), so
the merge falls into pieces of equal work that need nothing of each other: a
piece emits the pairs of tokens that end together within it.  A pair whose two
ends lie on both sides of a diagonal is found by the later piece, which looks at
one more end; groups that cross diagonals are stitched from the pairs in order.

Texts are encoded in runs cut at a space between two ASCII letters, where no
token of either vocabulary can cross (checked against the second vocabulary when
it is loaded), so long texts need little memory at once.  Linked pairs of ids are
counted on Spark.  Of two tokens that end together one's bytes end the other, so
the pairs are bounded by the vocabularies (``pair_bound``), whatever the corpus;
their counts are broadcast behind that bound.

Cases: null and empty texts, and texts that either tokenizer does not give back
byte by byte, have no tokens; repeated rows are aligned each; null ids stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.textcore import bound_batches
from cohortvox.sources.workspace import Workspace

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
A_FAST = "byte_bpe_50k.tiktoken"
#: Characters after which a run of text ends at the next safe cut.
RUN_CHARS = 1 << 16
#: Ends of a merge piece.
PIECE = 1 << 15
#: Tokens whose group text is built at once.
DIGEST_TOKENS = 1 << 18
MARK = "▁"
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Texts that the same vocabulary's faster encoder may take: letters assigned long ago, no very long run of one kind.
STABLE = re.compile("[\x00-ͯ]*")
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others for 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Digits:
    """The decimal digits of ids, by id."""

    def __init__(self, n: int):
        width = len(str(max(n - 1, 0)))
        names = [str(k).encode() for k in range(n)]
        self.digits = np.zeros((n, width + 1), np.uint8)
        self.digits[:, :width] = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in names), np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(x) for x in names], np.int64)


class Vocabulary:
    """Token bytes by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pair:
    """The two tokenizers.  ``fast`` is a second file of the first one's vocabulary, used where both encoders agree by construction."""

    def __init__(self, a_path: str, b_path: str, fast: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a_model = Tokenizer.from_file(a_path)
        self.a_model.encode_special_tokens = True
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = byte_level_alphabet()
        names = self.a_model.get_vocab(with_added_tokens=True)
        a = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            a[k] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        pieces = [self.b_model.id_to_piece(k) for k in range(len(self.b_model))]
        b = [bytes([int(p[3:5], 16)]) if self.b_model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a, self.b = Vocabulary(a), Vocabulary(b)
        self.cuts = all(MARK not in p.lstrip(MARK) for p in pieces) and self.b_model.encode("a", out_type=str) == [MARK + "a"]
        self.fast = self._same_by_ranks(fast) if fast else None

    def _same_by_ranks(self, path: str):
        """The encoder over ranks, if its vocabulary is the first tokenizer's without its special tokens."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(x): int(k) for x, k in map(bytes.split, f)}
        same = all(k < len(self.a.tokens) and self.a.tokens[k] == x for x, k in ranks.items()) and len(self.a.tokens) - len(ranks) <= 1
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None

    def runs(self, text: str) -> list[str]:
        """The text cut at single spaces between letters; these spaces are left out."""
        if len(text) <= RUN_CHARS or not self.cuts:
            return [text]
        out, a = [], 0
        while len(text) - a > RUN_CHARS:
            m = CUT.search(text, a + RUN_CHARS)
            if not m:
                break
            out.append(text[a : m.start()])
            a = m.end()
        return [*out, text[a:]]

    def _encode_a(self, run: str) -> list[int]:
        if self.fast and STABLE.fullmatch(run) and not LONG_RUN.search(run):
            return self.fast.encode_ordinary(" " + run)
        return self.a_model.encode(" " + run, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none where the bytes of either differ from a space and the text."""
        none = np.zeros(0, np.int64)
        a_all, b_all = [], []
        for run in self.runs(text) if text else []:
            a, b = self._encode_a(run), self.b_model.encode(run)
            whole = (" " + run).encode()
            if self.a.joined(a) != whole or self.b.joined(b) != whole:
                return none, none
            a_all.append(np.array(a, np.int64))
            b_all.append(np.array(b, np.int64))
        return (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (none, none)


_PAIRS: dict[tuple, Pair] = {}


def tokenizer_pair(paths: tuple[str, str, str | None] | None) -> Pair:
    """Loads the files once a process; without paths, the public ones installed there."""
    if paths not in _PAIRS:
        if paths is None:
            import public_tokenizers

            _PAIRS[paths] = Pair(*map(public_tokenizers.path, (A_NAME, B_NAME, A_FAST)))
        else:
            _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


def pair_bound(pair: Pair) -> int:
    """Pairs of ids whose bytes can end together: one is the end of the other."""
    total = 0
    for one, other, equal in ((pair.a, pair.b, True), (pair.b, pair.a, False)):
        counts: dict[bytes, int] = {}
        for t in other.tokens:
            counts[t] = counts.get(t, 0) + 1
        total += sum(counts.get(t[k:], 0) for t in one.tokens for k in range(0 if equal else 1, len(t)))
    return total


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and of ``b`` lie before each diagonal; of equal ends that of ``a`` comes first."""
    d = np.r_[np.arange(0, len(a) + len(b), piece), len(a) + len(b)]
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low, d - low
        mid = (low + high) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)


def piece_links(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that end together, both by index, of which that of ``b`` lies in the piece."""
    i0 = max(i0 - 1, 0)  # its partner may be the last end before the diagonal
    mine, other = b[j0:j1], a[i0:i1]
    at = np.searchsorted(other, mine)
    hit = np.flatnonzero(at < len(other))
    hit = hit[other[at[hit]] == mine[hit]]
    return i0 + at[hit], j0 + hit


def links(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (indices) whose ends are equal, in order; ends rise strictly."""
    i, j = diagonals(a, b, piece)
    found = [piece_links(a, b, *cut) for cut in zip(i, i[1:], j, j[1:])]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def group_digest(names: tuple[Digits, Digits], a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``; ``x`` and ``y`` are the last tokens of the groups."""
    state = hashlib.sha256()
    step = max(1, DIGEST_TOKENS * len(x) // max(len(a) + len(b), 1))
    a0 = b0 = 0
    for g in range(0, len(x), step):
        xs, ys = x[g : g + step] + 1 - a0, y[g : g + step] + 1 - b0  # ends of these groups from here
        ids_a, ids_b = a[a0 : a0 + xs[-1]], b[b0 : b0 + ys[-1]]
        na, nb = np.diff(xs, prepend=0), np.diff(ys, prepend=0)
        at_a = np.arange(len(ids_a)) + np.repeat(ys - nb, na)
        at_b = np.arange(len(ids_b)) + np.repeat(xs, nb)
        width = max(v.digits.shape[1] for v in names)
        text = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
        size = np.empty(len(text), np.int64)
        for v, ids, at in zip(names, (ids_a, ids_b), (at_a, at_b)):
            text[at, : v.digits.shape[1]] = v.digits[ids]
            size[at] = v.n_digits[ids]
        mark = np.full(len(text), ord(","), np.uint8)
        mark[at_a[xs - 1]] = ord("|")
        mark[at_b[ys - 1]] = ord(";")
        text[np.arange(len(text)), size] = mark
        piece = text[np.arange(width) <= size[:, None]].tobytes()
        a0, b0 = a0 + int(xs[-1]), b0 + int(ys[-1])
        state.update(piece if g + step < len(x) else piece[:-1])
    return state.hexdigest()


_ALIGNED = "doc_id bigint, a array<int>, b array<int>, a_last array<int>, b_last array<int>"


def aligned(docs: DataFrame, paths: tuple[str, str, str | None] | None = None, piece: int = PIECE) -> DataFrame:
    """``(doc_id, a, b, a_last, b_last)``: both tokenizers' ids and, for each group, the index of its last token of either.

    Tokens at equal places of ``a_last`` and ``b_last`` are the linked ones.
    The documents of an Arrow batch are merged as one sequence.
    """
    def lists(values: list[np.ndarray], ends: np.ndarray) -> pa.ListArray:
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))

    def run(batches):
        pair = tokenizer_pair(paths)
        for batch in batches:
            got = [pair.encode(t.as_py()) for t in batch.column("text")]
            ids = [[g[k] for g in got] for k in (0, 1)]
            ends = [np.cumsum([0, *map(len, v)]) for v in ids]
            bytes_ = [np.cumsum(np.concatenate([voc.length[v] for v in col]) if col else []) for voc, col in ((pair.a, ids[0]), (pair.b, ids[1]))]
            x, y = links(bytes_[0], bytes_[1], piece)
            doc = np.searchsorted(ends[0], x, "right") - 1
            cut = np.searchsorted(doc, np.arange(len(got) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists(ids[0], ends[0]), lists(ids[1], ends[1]), lists([x - ends[0][doc]], cut), lists([y - ends[1][doc]], cut)],
                ["doc_id", "a", "b", "a_last", "b_last"],
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.offsets.to_numpy(), col.values.to_numpy().astype(np.int64)


def summaries(groups: DataFrame, paths: tuple[str, str, str | None] | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, pairs)`` of ``aligned`` rows; a pair is A id x size of B's vocabulary + B id.

    Workers get the vocabularies' sizes only, not the tokenizers.
    """
    pair = tokenizer_pair(paths)
    na, nb = len(pair.a.tokens), len(pair.b.tokens)
    if na * nb >= 1 << 31:
        raise ValueError("pairs of these vocabularies do not fit 31 bits")

    def run(batches):
        names = Digits(na), Digits(nb)
        for batch in batches:
            off, ids = zip(*(_flat(batch.column(c)) for c in ("a", "b", "a_last", "b_last")))
            sha, pairs = [], []
            for k in range(batch.num_rows):
                a, b, x, y = (v[o[k] : o[k + 1]] for o, v in zip(off, ids))
                sha.append(group_digest(names, a, b, x, y) if len(a) else "")
                pairs.append(a[x] * nb + b[y])
            n = [pa.array(np.diff(o).astype(np.int64)) for o in off[:3]]
            flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
            links_ = pa.ListArray.from_arrays(pa.array((off[2] - off[2][0]).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, pa.array(sha, pa.string()), links_], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    return groups.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<int>")


def pair_counts(rows: DataFrame, paths: tuple[str, str, str | None] | None = None) -> DataFrame:
    """``(pair, n, best)``: how often each pair is linked, and whether none of its B id is more often."""
    nb = len(tokenizer_pair(paths).b.tokens)
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    top = counts.groupBy((F.col("pair") % nb).alias("b")).agg(F.max("n").alias("top"))
    return counts.join(top, F.col("pair") % nb == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def rate_links(rows: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """``summaries`` with (n_links, n_best, count_sum) in place of the pairs; ``counts`` has at most ``bound`` rows and is broadcast."""
    got = counts.orderBy("pair").limit(bound + 1).toArrow()
    if got.num_rows > bound:
        raise RuntimeError("more pairs than the vocabularies allow")
    table = tuple(got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            off, flat = _flat(batch.column("pairs"))
            off = off - off[0]
            at = np.searchsorted(pair, flat)
            sums = [np.r_[0, np.cumsum(v)][off] for v in (best[at].astype(np.int64), n[at])]
            values = [np.diff(off).astype(np.int64), *map(np.diff, sums)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], *map(pa.array, values), batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op13")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ws.table(summaries(aligned(docs)), "pairs")
    counts = ws.table(pair_counts(rows), "counts")
    return rate_links(rows, counts, pair_bound(tokenizer_pair(None)))
