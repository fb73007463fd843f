"""Lexical retrieval packing: neighbours by a sharded BM25 inverted index fill each seed's window.

A document's ids, with the closing id, are cut into whole windows, which need no filling, and a rest. The rests
are what is packed. They are ordered by two minimum hashes of their words, so that lexical neighbours, copies above all,
lie side by side; a range partitioning deals them out, with the id as last key, so a large group of copies
spreads over as many partitions as its size asks for. Each partition is a run of index shards of ``block`` rests:
an inverted index with BM25 weights from counts over the whole corpus. A seed (the first rest not yet used, or the tail of
one that was cut) asks its shard for the best unused neighbours, which fill the window; the last one is cut at
the window's end and its tail opens the next. So only the last window of a partition is padded.

Terms are words hashed to ``TERMS`` numbers, which bounds the table of document frequencies (2^18 numbers, broadcast) whatever
the corpus holds. A query takes the seed's ``query_terms`` rarest terms.

Edge cases: a null text counts as empty, a single closing id; null ids and repeated rows are documents of
their own; documents beyond a window are cut; an empty table gives an empty result; further columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, cut, table

TERMS = 1 << 18
K1, B = 1.2, 0.75
#: Neighbours that a seed asks for at a time; it asks again when they are used.
ASKED = 32
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Special tokens of the vocabulary. The library of its .json form reads their strings in texts as these ids by default.
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE of ``vocabulary`` (a file of ranks; the .json beside it has the same ids)."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def word_tables(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id: does it open a word, and a number to mix into the word's hash."""
    enc = encoder(vocabulary)
    opens = np.ones(enc.n_vocab, dtype=bool)
    for i in range(enc.n_vocab):
        piece = enc.decode_single_token_bytes(i)
        opens[i] = not piece[:1].isalnum() and piece[0] < 128
    with np.errstate(over="ignore"):
        x = (np.arange(enc.n_vocab, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return opens, x ^ (x >> np.uint64(31))


def word_hashes(ids: np.ndarray, begins: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``ids``, which holds texts that begin at ``begins``, and how many each text has."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    opens, mix = word_tables(vocabulary)
    first = opens[ids]
    first[begins[begins < len(ids)]] = True
    at = np.flatnonzero(first)
    place = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    with np.errstate(over="ignore"):
        hashed = np.add.reduceat(mix[ids] * (2 * place + 1).astype(np.uint64), at)
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ends = np.append(begins[1:], len(ids))
    return hashed, np.searchsorted(at, ends) - np.searchsorted(at, begins)


def begins_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def tokenised(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int, close: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in batches:
        fulls, rests, counts = [], [], []
        for text in batch.column(1).to_pylist():
            ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), close).astype("<u4")
            whole = len(ids) // window * window
            fulls.append([zlib.crc32(ids[k : k + window].tobytes()) for k in range(0, whole, window)])
            rests.append(ids[whole:])
            counts.append(len(ids))
        sizes = np.array([len(x) for x in rests], dtype=np.int64)
        hashed, words = word_hashes(np.concatenate(rests) if rests else np.zeros(0, "<u4"), begins_of(sizes), vocabulary)
        low, some = [], np.flatnonzero(words)
        for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            least = np.zeros(len(words), dtype=np.int64)
            if len(some):
                with np.errstate(over="ignore"):
                    least[some] = np.minimum.reduceat((hashed * np.uint64(factor)) >> np.uint64(33), begins_of(words[some])).astype(np.int64)
            low.append(pa.array(least))
        yield pa.record_batch(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(fulls, pa.list_(pa.int64())), pa.array([x.astype("<u2").tobytes() for x in rests], pa.binary()), *low],
            ["doc_id", "doc_tokens", "full", "rest", "low1", "low2"],
        )


def frequencies(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """term and in how many rests it is; term -1: rests, -2: words."""
    seen, rests, words = np.zeros(TERMS, np.int64), 0, 0
    for batch in batches:
        row, term = terms_of([np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()], vocabulary)
        seen += np.bincount(np.unique(row * TERMS + term) % TERMS, minlength=TERMS)
        rests += batch.num_rows
        words += len(term)
    at = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((seen[at], [rests, words])))], ["term", "n"])


def terms_of(rests: list[np.ndarray], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the rest that has it, and its term."""
    sizes = np.array([len(x) for x in rests], dtype=np.int64)
    hashed, words = word_hashes(np.concatenate(rests).astype(np.int64) if rests else np.zeros(0, np.int64), begins_of(sizes), vocabulary)
    return np.repeat(np.arange(len(rests)), words), (hashed >> np.uint64(46)).astype(np.int64)


class Shard:
    """A BM25 inverted index of some rests."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float, vocabulary: str, query_terms: int):
        n = self.n = len(rests)
        row, term = terms_of(rests, vocabulary)
        words = np.bincount(row, minlength=n)
        keys, tf = np.unique(term * n + row, return_counts=True)
        self.rows = keys % n if n else keys
        terms = keys // n if n else keys
        self.weights = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[self.rows] / mean))
        change = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
        self.begin, self.end = change, np.append(change[1:], len(terms))
        which = np.cumsum(np.isin(np.arange(len(terms)), change)) - 1  # of each posting, its term's place
        rare = np.lexsort((-idf[terms], self.rows))
        at = np.searchsorted(self.rows[rare], np.arange(n + 1))
        self.queries = [which[rare[at[i] : min(at[i + 1], at[i] + query_terms)]] for i in range(n)]

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> list[int]:
        """Unused rests by falling score against the seed; ties by place."""
        spans = [(self.begin[t], self.end[t]) for t in self.queries[seed]]
        if not spans:
            return []
        score = np.bincount(np.concatenate([self.rows[a:b] for a, b in spans]), np.concatenate([self.weights[a:b] for a, b in spans]), self.n)
        score[used] = 0
        best = np.argpartition(-score, most)[:most] if most < self.n else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


def fill(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, vocabulary: str, window: int, block: int, query_terms: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    number, used_room = TaskContext.get().partitionId() << 36, 0  # the open sequence and what of it is filled
    wholes = number | 1 << 35  # sequences that one document fills are numbered apart
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECE.split(", ")]
        cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))]
        if with_ids:
            cols.append(pa.array([r[len(names)] for r in out], pa.list_(pa.int32())))
            names.append("ids")
        out.clear()
        return pa.record_batch(cols, names)

    def blocks() -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= block:
                yield held[:block]
                held = held[block:]
        if held:
            yield held

    for rows in blocks():
        for r in rows:
            for k, crc in enumerate(r["full"]):
                out.append((r["doc_id"], k * window, window, crc, r["doc_tokens"], wholes, 0, None))
                wholes += 1
        rows = [r for r in rows if r["rest"]]
        rests = [np.frombuffer(r["rest"], "<u2") for r in rows]
        shard = Shard(rests, idf, mean, vocabulary, query_terms)
        used, following = np.zeros(len(rows), dtype=bool), 0
        queue: list[int] = []
        seed: int | None = None  # of the open window
        while True:
            queue = [i for i in queue if not used[i]] or (shard.neighbours(seed, used, ASKED) if seed is not None else [])
            if queue:
                i = queue.pop(0)
            else:
                while following < len(rows) and used[following]:
                    following += 1
                if following == len(rows):
                    break
                i = seed = following
            used[i] = True
            r, ids = rows[i], rests[i]
            base, at = r["doc_tokens"] - len(ids), 0
            while at < len(ids):
                take = min(len(ids) - at, window - used_room)
                piece = ids[at : at + take].astype("<u4")
                out.append((r["doc_id"], base + at, take, zlib.crc32(piece.tobytes()), r["doc_tokens"], number, used_room, piece.astype("<i4") if with_ids else None))
                at += take
                used_room += take
                if used_room == window:
                    number, used_room = number + 1, 0
                    queue, seed = [], i if at < len(ids) else None
        if len(out) > 4096:
            yield emit()
    if out:
        yield emit()


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", window: int = 1024, close: int = 0, block: int = 2048, query_terms: int = 32, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` on demand
    (of pieces from rests; a whole window's are its document's)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = cut(arrow_stage(rows, lambda it: tokenised(it, vocabulary, window, close), "doc_id long, doc_tokens long, full array<long>, rest binary, low1 long, low2 long"), "rests")
    counted = arrow_stage(held.select("rest"), lambda it: frequencies(it, vocabulary), "term long, n long")
    got = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 2 rows at most
    n = np.zeros(TERMS + 2)
    n[got["term"].to_numpy()] = got["n"].to_numpy()
    rests, words = max(1.0, n[-1]), max(1.0, n[-2])
    idf = np.log1p((rests - n[:TERMS] + 0.5) / (n[:TERMS] + 0.5)).clip(0).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    mean = words / rests
    order = ["low1", "low2", "doc_id"]
    dealt = held.repartitionByRange(*order).sortWithinPartitions(*order, "doc_tokens", "rest")
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return arrow_stage(dealt, lambda it: fill(it, shared.value, mean, vocabulary, window, block, query_terms, with_ids), schema)


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
