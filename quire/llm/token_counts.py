"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded at once, in batches. A longer one is encoded in
chunks that overlap. Each chunk's token boundaries are known as byte offsets (every piece of the
vocabulary has a fixed byte length), so two neighbours are spliced at a boundary both have inside
the overlap and that is *proven stable*: a space after something else than a space. No piece of
the vocabulary holds a space after another character (checked when the model is loaded), so no merge
crosses such a place and what stands left of it cannot depend on what stands right of it. Without
such a place in the overlap the overlap doubles, in the end to the whole rest of the text.

Edge cases: a null text counts as empty (0 tokens); null ids and repeated rows stay rows of their own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_stage, table

SPACE = "▁"


class Counter:
    """Counts pieces of whole texts; ``widened`` tells how often an overlap had to grow."""

    def __init__(self, model_file: str, chunk: int = 16_384, overlap: int = 256):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = np.array([1 if self.model.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)], dtype=np.int64)
        self.provable = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and the byte offset at which each begins (the added first space is at -1); None where
        lengths do not add up, as for a text that holds the space mark itself."""
        ids = np.array(self.model.encode(text, num_threads=1), dtype=np.int64)
        ends = np.cumsum(self.bytes_of[ids]) - 1
        if len(ids) and ends[-1] != len(text.encode()):
            return None
        return ids, ends - self.bytes_of[ids]

    def stable(self, text: str, low: int, high: int) -> int | None:
        """The first place in (low, high) that has a space after another character."""
        at = text.find(" ", low + 1, high)
        while at > 0:
            if text[at - 1] not in (" ", SPACE):
                return at
            at = text.find(" ", at + 1, high)
        return None

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.provable:
            return len(self.model.encode(text, num_threads=1))
        total, begin = 0, 0  # tokens before the character ``begin`` are counted
        while (end := begin + self.chunk) < len(text):
            overlap = self.overlap
            while (found := self._splice(text, begin, end - overlap, end)) is None:
                self.widened += 1
                overlap *= 2
                end += overlap
                if end >= len(text):
                    return total + self._rest(text, begin)
            total, begin = total + found[0], found[1]
        return total + self._rest(text, begin)

    def _rest(self, text: str, begin: int) -> int:
        return len(self.model.encode(text[begin + (begin > 0) :], num_threads=1))

    def _offsets(self, text: str, begin: int, end: int) -> np.ndarray | None:
        """Byte offsets, from ``begin``, of the tokens of text[begin:end]. Where a chunk starts at a splice, the
        space found there is the one that the model puts before any text."""
        lead = begin > 0
        got = self.encode(text[begin + lead : end])
        return None if got is None else got[1] + lead

    def _splice(self, text: str, begin: int, low: int, end: int) -> tuple[int, int] | None:
        """Tokens of the chunk before the splice, and the splice; None if the overlap has no stable place or
        the two encodings differ in what follows it."""
        at = self.stable(text, low, end)
        if at is None or (left := self._offsets(text, begin, end)) is None or (right := self._offsets(text, at, end)) is None:
            return None
        byte = len(text[begin:at].encode())
        before = int(np.searchsorted(left, byte))
        return (before, at) if len(right) and np.array_equal(left[before:], right + byte) else None


def counted(batches: Iterator[pa.RecordBatch], model_file: str, chunk: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(model_file, chunk)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        out = np.zeros(len(texts), dtype=np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= counter.chunk]
        for k in range(0, len(short), 64):
            some = short[k : k + 64]
            out[some] = [len(x) for x in counter.model.encode([texts[i] for i in some], num_threads=1)]
        for i in sorted(set(range(len(texts))) - set(short)):
            out[i] = counter.count(texts[i])
        yield pa.record_batch([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(out)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    out = arrow_stage(rows, lambda it: counted(it, model_file, chunk), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", out["n_tokens"] > limit)


def op5_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
