"""Token counts of a SentencePiece BPE model by a whole-token shortcut.

The model's vocabulary never joins characters across the start of a run of word
marks, nor across a character that occurs in no longer piece.  A text therefore
falls into pre-tokens whose tokens add up.  Which vocabulary strings stand alone
as one token is proved offline, once a process, by encoding each of them in
isolation; a pre-token among them counts one without a merge, and only the rest
are merged (once each while a bounded memory of counts holds them).

The two properties are checked against the vocabulary when the model is loaded;
a model without them (or with a normaliser) is counted text by text.

Cases: a null or empty text has no tokens; repeated rows are counted each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.llm.textcore import bound_batches

LIMIT = 4_096
#: Pre-tokens whose counts a worker remembers (about 150 bytes each).
MEMORY = 200_000
MARK = "▁"


class PieceCounter:
    def __init__(self, path: str, memory: int = MEMORY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit = memory
        pieces = [self.model.id_to_piece(k) for k in range(len(self.model))]
        texts = [p for k, p in enumerate(pieces) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k) or self.model.is_unused(k))]
        self.splits = self._separable(texts)
        self.newline = not any("\n" in p for p in texts)
        self.whole = self._prove(texts) if self.splits else {}
        self.memory: dict[str, int] = {}

    def _separable(self, pieces: list[str]) -> bool:
        """Word marks only lead a piece, and texts reach the merges as they are."""
        plain = all(MARK not in p.lstrip(MARK) for p in pieces)
        probes = ["a  b c\tﬁ ́e ", " x", "A▁b", "Å"]
        same = all(self.model.decode(self.model.encode(t)) == t.replace(MARK, " ") for t in probes)
        return plain and same and self._leads_with_mark()

    def _leads_with_mark(self) -> bool:
        """A leading word mark is added to every text that is not empty."""
        return self.model.encode("a", out_type=str) == [MARK + "a"] and not self.model.encode("")

    def _merge(self, pre: str) -> int:
        """Tokens of one pre-token, merged alone.

        The model puts a word mark in front.  A pre-token that begins with one
        gives it up for that; any other is encoded behind a newline, which no
        piece contains, and the tokens of mark and newline are taken off.
        """
        if pre[0] == " ":
            return len(self.model.encode(pre[1:])) if len(pre) > 1 else 1
        return len(self.model.encode("\n" + pre)) - self._front

    def _prove(self, pieces: list[str]) -> dict[str, int]:
        self._front = len(self.model.encode("\n"))
        alone = {}
        for p in pieces:
            text = p.replace(MARK, " ")
            if text and "\n" not in text and (text.startswith(" ") or self.newline) and self._merge(text) == 1:
                alone[text] = 1
        return alone

    def _count(self, pre: str) -> int:
        n = self.whole.get(pre) or self.memory.get(pre)
        if n is None:
            if len(self.memory) >= self.limit:
                self.memory.clear()
            n = self.memory[pre] = self._merge(pre)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not (self.splits and self.newline):
            return len(self.model.encode(text))
        total, first = 0, True
        whole, memory, count = self.whole, self.memory, self._count
        for line in text.replace(MARK, " ").split("\n"):
            if first:  # the model's own leading mark
                words = (" " + line).split(" ")
            else:
                total += self._newline
                words = line.split(" ")
            first = False
            if words[0]:
                total += count(words[0])
            blanks = ""
            for w in words[1:]:
                if w:
                    pre = blanks + " " + w
                    total += whole.get(pre) or memory.get(pre) or count(pre)
                    blanks = ""
                else:
                    blanks += " "
            if blanks:
                total += count(blanks)
        return total

    @property
    def _newline(self) -> int:
        n = self.__dict__.get("_nl")
        if n is None:
            n = self.__dict__["_nl"] = len(self.model.encode("a\nb")) - len(self.model.encode("a")) - self._merge("b")
        return n


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per document.

    ``model_path`` is a path on every executor; without one, the public model
    installed there is used.
    """

    def run(batches):
        path = model_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        c = counter(path)
        for batch in batches:
            text = batch.column("text")
            size = pa.compute.fill_null(pa.compute.binary_length(text), 0).cast(pa.int64())
            n = np.array([c.count(text[k].as_py()) for k in range(len(text))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
