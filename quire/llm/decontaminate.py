"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts writes them as numbers of the benchmark's words and counts the words' document frequencies over the
   whole corpus, which give the TF-IDF weights. Documents without a window that is dense enough in these words (``density``) fall away.
2. A place can only be reported if ``loose`` of an item's words are in the stretch where the item would lie. So of any n - need + t of
   its n words at least t are there; with the rarest ones this leaves few places. Windows of ``WINDOW`` words, ``STRIDE`` apart, around
   them are the passages that the next steps work on (``near``, written).
3. A randomised SVD of the TF-IDF passages finds ``RANK`` latent directions: each task adds up its passages' part of A'(A G), the parts
   are summed by term, and the driver (terms x RANK numbers, terms bounded by the block of benchmark items) orthonormalises and
   repeats. It is fitted on the items' passages and on all of step 2, each word once.
4. All windows of step 2 are projected and compared with every passage of each item; those with a cosine of ``COSINE`` are candidates.
5. The longest common subsequence of an item's words and the stretch decides: ``strict`` of the item's words,
   or ``loose`` of them if the answer, the item's last words, is there as well.

Benchmarks of any size are taken in blocks of ``BLOCK`` items; each block is broadcast, its size being bounded.

Edge cases: null or empty texts match nothing; null ids are reported as null; items of fewer than ``SHORTEST`` words are not searched for; an item twice in the
benchmark is reported under each id; a document with an item twice is reported once, with its best match; repeated rows are
reported each; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, cut, drop_cut, table

RANK, ROUNDS = 192, 2
#: Windows that a task of the fit adds up, and numbers that a step of the search holds at once.
FIT_WINDOWS, HELD = 500_000, 4_000_000
WINDOW, STRIDE, COSINE = 12, 4, 0.65
BLOCK, SHORTEST, ANSWER = 2048, 8, 5
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bits of an integer at a time (Hyyro 2004)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """A block of benchmark items: their vocabulary and their passages (windows of each item)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, t in rows if len(words_of(t)) >= SHORTEST]
        self.words = [words_of(t) for _, t in rows if len(words_of(t)) >= SHORTEST]
        self.vocab: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        self.passages = [(k, at) for k, w in enumerate(self.words) for at in sorted({*range(0, max(1, len(w) - WINDOW + 1), STRIDE), max(0, len(w) - WINDOW)})]

    def matrix(self) -> np.ndarray:
        """Term numbers of each passage, -1 where there is none."""
        out = np.full((len(self.passages), WINDOW), -1, np.int64)
        for r, (k, at) in enumerate(self.passages):
            part = [self.vocab[x] for x in self.words[k][at : at + WINDOW]]
            out[r, : len(part)] = part
        return out


def slack_of(n: int) -> int:
    """How far a stretch reaches beyond where an item of ``n`` words would lie, at either end."""
    return n // 6 + 3


def density(items: Items, share: float) -> float:
    """The share of a window's words that are the benchmark's, at least, in some window of any stretch in which an item reaches
    ``share``: the stretch is covered by so many windows at multiples of STRIDE, and they hold all of the item's words."""
    least = 1.0
    for n in {len(w) for w in items.words}:
        covers = -(-(n + 2 * slack_of(n) + STRIDE - 1) // WINDOW)
        least = min(least, share * n / covers / WINDOW)
    return least


class Anchors:
    """For each word the items that have it among their rarest, and how many of these a stretch of an item has at least."""

    def __init__(self, items: Items, df: np.ndarray, share: float):
        of_word: list[list[int]] = [[] for _ in items.vocab]
        least, reach = [], []
        for k, words in enumerate(items.words):
            terms = [items.vocab[w] for w in words]
            n, need = len(terms), math.ceil(share * len(terms) - 1e-9)
            least.append(max(1, n // 3))
            reach.append(n + 2 * slack_of(n))
            rarest = sorted(range(n), key=lambda i: (df[terms[i]], terms[i], i))[: n - need + least[-1]]
            for t in {terms[i] for i in rarest}:
                of_word[t].append(k)
        self.count = np.array([*map(len, of_word), 0])  # the last: no term
        self.begin = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.items = np.array([k for own in of_word for k in own], dtype=np.int64)
        self.least, self.reach = np.array(least), np.array(reach)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the windows around the places where some item's stretch can be."""
        n = len(terms)
        at = np.flatnonzero(self.count[terms])
        many = self.count[terms[at]]
        place = np.repeat(at, many)
        item = self.items[np.repeat(self.begin[terms[at]] - np.cumsum(many) + many, many) + np.arange(len(place))]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        last = np.arange(len(place)) + self.least[item] - 1
        inside = last < len(place)
        last = np.minimum(last, len(place) - 1)
        inside &= (item[last] == item) & (place[last] - place < self.reach[item])
        if not inside.any():
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(0, place[last][inside] - self.reach[item[inside]]), 1)
        np.add.at(edge, np.minimum(n, place[inside] + self.reach[item[inside]]), -1)
        starts = windows(terms, 0.0)
        return starts[np.cumsum(edge)[starts] > 0]


def numbered(words: list[str], vocab: dict[str, int]) -> np.ndarray:
    get = vocab.get
    return np.array([get(w, -1) for w in words], dtype=np.int64)


def windows(terms: np.ndarray, least: float) -> np.ndarray:
    """Starts of the windows in which at least ``least`` words are of the vocabulary."""
    n = len(terms)
    if n <= WINDOW:
        starts = np.zeros(1 if n else 0, np.int64)
        return starts if n and (terms >= 0).sum() >= least * n else starts[:0]
    total = np.concatenate(([0], np.cumsum(terms >= 0)))
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE).clip(max=n - WINDOW)
    return starts[total[starts + WINDOW] - total[starts] >= least * WINDOW]


def gathered(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)[None, :]
    return np.where(at < len(terms), terms[np.minimum(at, len(terms) - 1)], -1)


def project(matrix: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages; ``basis`` has the weights in it and a zero row for -1 at its end."""
    v = basis[matrix].sum(axis=1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def numbered_docs(docs: DataFrame, vocab: dict[str, int], least: float) -> DataFrame:
    """One pass over the texts, written: (doc_id, terms, seen). ``terms`` are a document's words as numbers of the
    vocabulary, for the documents with a window that holds enough of them; one row of each task has ``seen`` instead: its
    number of documents, then in how many of them each word is."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # BLOCK items at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        seen, n = np.zeros(len(vocab) + 1, np.int64), 0
        held = pa.schema([("doc_id", pa.int64()), ("terms", pa.binary()), ("seen", pa.list_(pa.int64()))])
        for batch in batches:
            ids, kept = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = numbered(words_of(text.as_py()), vocab)
                has = np.zeros(len(vocab) + 1, bool)  # the last: no term
                has[t] = True
                seen += has
                if len(windows(t, least)):
                    ids.append(doc)
                    kept.append(t)
            n += batch.num_rows
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), packed(kept), pa.nulls(len(ids), held.field(2).type)], schema=held)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, held.field(1).type), pa.array([[n, *seen[:-1].tolist()]], held.field(2).type)], schema=held)

    return cut(arrow_stage(docs, each, "doc_id long, terms binary, seen array<long>", rows=256), "terms")


def frequencies(held: DataFrame, vocab: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary is, and the number of documents."""
    got = held.where("seen IS NOT NULL").select(F.posexplode("seen").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocab) + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[1:], int(out[0])


def packed(rows: list[np.ndarray]) -> pa.Array:
    """Rows of numbers as 32-bit ones in bytes: Spark reads, copies and writes such a value as a whole, an array number by number."""
    return pa.array([x.astype("<i4").tobytes() for x in rows], pa.binary())


def term_arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows that ``packed`` has written."""
    return [np.frombuffer(x.as_buffer(), "<i4") for x in column]


def near_places(held: DataFrame, items: Items, df: np.ndarray, loose: float) -> DataFrame:
    """doc_id, terms, starts of the documents with windows that can belong to an item; written."""
    shared = held.sparkSession.sparkContext.broadcast(Anchors(items, df, loose))  # BLOCK items at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        for batch in batches:
            starts = [anchors.places(t) for t in term_arrays(batch.column(1))]
            some = np.flatnonzero([len(x) for x in starts])
            if len(some):
                kept = batch.take(pa.array(some))
                yield pa.record_batch([kept.column(0), kept.column(1), packed([starts[i] for i in some])], ["doc_id", "terms", "starts"])

    return cut(arrow_stage(held, each, "doc_id long, terms binary, starts binary", rows=256), "near")


def latent(near: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors, weighted: terms + 1 rows (the last is zero) of ``rank`` numbers."""
    rng = np.random.default_rng(5)
    terms = len(items.vocab)
    rank = min(rank, terms)
    basis = rng.standard_normal((terms, rank))
    spark, own = near.sparkSession, items.matrix()
    n = (near.agg(F.sum(F.octet_length("starts"))).first()[0] or 0) // 4

    def product(matrices: Iterator[np.ndarray], g: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A'(A g), with A's rows the weighted words of each passage."""
        g, out = np.append(g * weights[:, None], np.zeros((1, g.shape[1])), axis=0), np.zeros((len(g) + 1, g.shape[1]))
        for matrix in matrices:
            for k in range(0, len(matrix), 512):
                part = matrix[k : k + 512]
                y = g[part].sum(axis=1)
                flat = part.ravel()
                order = np.argsort(flat, kind="stable")
                change = np.flatnonzero(np.diff(flat[order], prepend=-2))
                out[flat[order][change]] += np.add.reduceat(y[order // WINDOW], change, axis=0)
        return out[:-1] * weights[:, None]

    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(basis)
        shared = spark.sparkContext.broadcast((basis, idf))  # terms x RANK numbers

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, weights = shared.value  # noqa: B023
            every = (gathered(t, apart(at)) for b in batches for t, at in zip(term_arrays(b.column(0)), term_arrays(b.column(1))))
            total = product(every, g, weights)
            some = np.flatnonzero(total.any(axis=1))
            dims = g.shape[1]
            yield pa.record_batch([pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(total[some].ravel())], ["term", "dim", "x"])

        parts = arrow_stage(near.select("terms", "starts").coalesce(-(-n // FIT_WINDOWS) + 2), each, "term int, dim int, x double")
        got = parts.groupBy("term", "dim").agg(F.sum("x").cast("float").alias("x")).toArrow()  # terms x RANK rows
        basis = product(iter([own]), basis, idf)
        np.add.at(basis, (got["term"].to_numpy(), got["dim"].to_numpy()), got["x"].to_numpy())
        del got
        shared.destroy()
    basis, _ = np.linalg.qr(basis)
    return np.append(basis * idf[:, None], np.zeros((1, rank)), axis=0).astype(np.float32)


def apart(starts: np.ndarray) -> np.ndarray:
    """Of windows that overlap, those that lie side by side, so that each word is in one of them."""
    return starts[starts // STRIDE % (WINDOW // STRIDE) == 0]


def judge(item: list, words: list, at: int, offset: int) -> tuple[float, float, int, int]:
    """Shares of the item's words and of its answer's in the stretch where the item would lie; the stretch."""
    slack = slack_of(len(item))
    low, high = max(0, at - offset - slack), min(len(words), at - offset + len(item) + slack)
    part = words[low:high]
    answer = item[-ANSWER:]
    return lcs(item, part) / len(item), lcs(answer, part[-(ANSWER + 2 * slack + STRIDE) :]) / len(answer), low, high


class Bounds:
    """What the words of a stretch, in any order, leave possible for an item."""

    def __init__(self, items: Items, strict: float, loose: float):
        self.wanted = [[items.vocab[x] for x in w] for w in items.words]
        self.size = np.array([len(w) for w in self.wanted])
        self.slack = np.array([slack_of(n) for n in self.size.tolist()])
        self.times = np.zeros((len(self.wanted), len(items.vocab) + 1), dtype=np.uint8)  # of a word in an item; the last column: no term
        self.answer = np.full((len(self.wanted), ANSWER), -2)
        for k, w in enumerate(self.wanted):
            np.add.at(self.times[k], w, 1)
            self.answer[k, : len(w[-ANSWER:])] = w[-ANSWER:]
        self.strict, self.loose = strict * self.size - 1e-9, loose * self.size - 1e-9

    def possible(self, terms: np.ndarray, item: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Which places can pass? No common subsequence is longer than the item's words in the stretch, each as often as the item has it."""
        out = np.zeros(len(item), dtype=bool)
        width = int((self.size + 2 * self.slack).max())
        for k in range(0, len(item), 8192):
            own, low = item[k : k + 8192], (centre - self.slack[item])[k : k + 8192]
            at = low[:, None] + np.arange(width)[None, :]
            inside = (at >= 0) & (at < len(terms)) & (at < (low + self.size[own] + 2 * self.slack[own])[:, None])
            part = np.sort(np.where(inside, terms[np.clip(at, 0, len(terms) - 1)], -1), axis=1)
            first = np.diff(part, axis=1, prepend=-2) != 0
            nth = np.arange(width)[None, :] - np.maximum.accumulate(np.where(first, np.arange(width)[None, :], 0), axis=1)
            held = (nth < self.times[own[:, None], part]).sum(axis=1)
            some = np.flatnonzero(held >= self.loose[own])
            answer = self.answer[own[some]]
            ends = (part[some][:, :, None] == answer[:, None, :]).any(axis=1).sum(axis=1) >= 0.8 * (answer >= 0).sum(axis=1)
            out[k + some] = ends | (held[some] >= self.strict[own[some]])
        return out


def search(near: DataFrame, items: Items, basis: np.ndarray, strict: float, loose: float) -> DataFrame:
    passages = project(items.matrix(), basis)
    shared = near.sparkSession.sparkContext.broadcast((items, basis, passages))  # BLOCK items at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, basis, passages = shared.value
        owner, offset = np.array(items.passages).T
        step = max(1, HELD // max(len(passages), WINDOW * basis.shape[1]))
        bounds = Bounds(items, strict, loose)
        for batch in batches:
            out = []
            for doc, terms, starts in zip(batch.column(0).to_pylist(), term_arrays(batch.column(1)), term_arrays(batch.column(2))):
                best: dict[int, tuple] = {}
                words: list[int] = []
                for k in range(0, len(starts), step):
                    cosines = project(gathered(terms, starts[k : k + step]), basis) @ passages.T
                    r, c = np.nonzero(cosines >= COSINE)
                    item, place, cosine = owner[c], (starts[k + r] - offset[c]) // STRIDE, cosines[r, c]
                    order = np.lexsort((-cosine, place, item))
                    item, place, cosine = item[order], place[order], cosine[order]
                    first = (np.diff(item, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0)
                    item, centre, cosine = item[first], place[first] * STRIDE + STRIDE // 2, cosine[first]
                    for i in np.flatnonzero(bounds.possible(terms, item, centre)).tolist():
                        own = int(item[i])
                        words = words or terms.tolist()
                        share, answer, low, high = judge(bounds.wanted[own], words, int(centre[i]), 0)
                        if share >= strict or share >= loose and answer >= 0.8:
                            best[own] = max(best.get(own, (0.0,)), (share, answer, float(cosine[i]), low, high))
                out += [(doc, items.ids[i], *v) for i, v in sorted(best.items())]
            if out:
                doc, item, share, answer, cosine, low, high = zip(*out)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share), pa.array(answer), pa.array(cosine), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["doc_id", "item_id", "lcs_share", "answer_share", "cosine", "first_word", "end_word"])

    return arrow_stage(near, each, "doc_id long, item_id long, lcs_share double, answer_share double, cosine double, first_word long, end_word long", rows=256)


def leaks(docs: DataFrame, benchmark: DataFrame, strict: float = 0.8, loose: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, cosine, first_word, end_word for each document that has an item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.where("text IS NOT NULL").select("item_id", "text")
    blocks = -(-bench.count() // BLOCK) or 1
    out = None
    for b in range(blocks):
        # about BLOCK items, which blocks of a hash share out
        items = Items(sorted((r[0], r[1]) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()))
        if items.passages:
            held = numbered_docs(rows, items.vocab, density(items, loose))
            df, n = frequencies(held, items.vocab)
            near = near_places(held.where("terms IS NOT NULL").select("doc_id", "terms"), items, df, loose)
            drop_cut(held)
            found = search(near, items, latent(near, items, np.log1p(max(1, n) / (df + 1.0))), strict, loose)
            out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, lcs_share double, answer_share double, cosine double, first_word long, end_word long")
    return out


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
