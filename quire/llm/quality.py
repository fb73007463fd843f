"""Ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed text features is shared by all grades;
ordered thresholds t0 < t1 split its score: P(grade <= k) = sigmoid(t_k - score). The expected grade and the tail
probability P(grade >= 2) select documents.

Features are the presence of words and of token shapes (letters and digits folded, so "word$$$" and "WORD!!" show),
and buckets of length and repetition, hashed to ``WIDTH`` numbers. The model is fitted on at most
``max_labelled`` labelled documents, those with the least hash of their id, whatever the size of the corpus. Features in fewer
than ``MIN_DOCS`` of them get no weight. Their features are a written table; each step adds up the slopes of its parts, so the driver
holds vectors of ``WIDTH`` numbers and no text or feature list.

Edge cases: a null text counts as empty, and a text without words is graded by the model but never kept; ties at the threshold
are kept; repeated rows stay; of several labels of a document any toxic one counts and else the worse quality; null labels are
no labels; without labelled documents of at least two grades there is no model: ``train`` raises NoGrades (a ValueError), ``fitted``
gives None, and every text with words is kept with null grades; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, cut, drop_cut, free_name, table

WIDTH = 1 << 18
MIN_DOCS = 4
CACHED = 300_000
#: The number of rows for which the lasso penalty is given.
PENALTY_ROWS = 20_000
#: Parts of the labelled table, and rows that a part works on at once.
PARTS, PART = 8, 2_000
UPPER, LOWER, DIGITS = re.compile(r"[^\W\d_a-zß-ÿ]{2,}"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
PLAIN = {"a", "a.", "a,", ""}


def features_of_token(token: str) -> tuple[int, ...]:
    """Of its letters, lower-cased, and of its shape if that is an unusual one."""
    word = "".join(LOWER.findall(token)).lower()
    shape = DIGITS.sub("9", LOWER.sub("a", UPPER.sub("Ā", token)))
    out = [zlib.crc32(b"w" + word.encode()) % WIDTH] if word else []
    if shape not in PLAIN:
        out.append(zlib.crc32(b"s" + shape.encode()) % WIDTH)
    return tuple(out)


def features_of_text(words: int, distinct: int, odd: int) -> tuple[int, ...]:
    """Buckets of length, of repetition and of the share of distinct tokens with an unusual shape."""
    shares = (b"l%d" % words.bit_length(), b"r%d" % (10 * distinct // max(1, words)), b"o%d" % (10 * odd // max(1, distinct)))
    return tuple(zlib.crc32(x) % WIDTH for x in shares)


class Features:
    """Distinct feature numbers of texts; tokens met before are looked up."""

    def __init__(self, weighted: np.ndarray | None = None):
        self.weighted, self.cache = weighted, {}

    def of(self, text: str) -> list[int]:
        tokens = text.split()
        distinct = set(tokens)
        cache, out, odd = self.cache, set(), 0
        if len(cache) > CACHED:
            cache.clear()
        for t in distinct:
            got = cache.get(t)
            if got is None:
                got = features_of_token(t)
                strange = len(got) > 1 or not LOWER.search(t)
                if self.weighted is not None:
                    got = tuple(x for x in got if self.weighted[x])
                cache[t] = got = (got, strange)
            if got[0]:
                out.update(got[0])
            odd += got[1]
        out.update(features_of_text(len(tokens), len(distinct), odd))
        return sorted(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """weights, thresholds (rising); ``probability(k)`` of grades up to k."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probability of the highest one."""
        below = sigmoid(self.thresholds[None, :] - scores[:, None])
        return (1 - below).sum(axis=1), 1 - below[:, -1]


class NoGrades(ValueError):
    """Labels of fewer than two grades: there is nothing to tell apart."""


def part_of(own: Model, free: np.ndarray, rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """What some rows add to the negative log-likelihood and to its slopes by the weights and by the thresholds. Each item of
    ``rows``: feature numbers one row after another, how many each row has, grades."""
    loss, by_weight, by_cut = 0.0, np.zeros(len(own.weights)), np.zeros(len(free))
    for flat, sizes, grades in rows:
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        score = np.bincount(owner, own.weights[flat], n)
        edge = np.concatenate((np.zeros((n, 1)), sigmoid(own.thresholds[None, :] - score[:, None]), np.ones((n, 1))), axis=1)
        slope, at = edge * (1 - edge), np.arange(n)
        p = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-9)
        up, down = slope[at, grades + 1] / p, slope[at, grades] / p
        loss -= float(np.log(p).sum())
        by_weight += np.bincount(flat, (up - down)[owner], len(by_weight))  # each threshold's term has the opposite sign
        for k in range(len(free)):
            by_cut[k] += down[grades == k + 1].sum() - up[grades == k].sum()
    # the gaps between thresholds are exponentials, so they stay in order
    return loss, by_weight, np.array([by_cut[k:].sum() * (np.exp(free[k]) if k else 1.0) for k in range(len(free))])


def thresholds_of(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def least(slopes: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, lasso: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """The place of the least loss with a lasso penalty, by limited-memory quasi-Newton steps that stay within an orthant (Andrew and
    Gao 2007); ends at ``rounds`` steps or where one gains less than 1e-4 of the loss."""
    loss, grad = slopes(x)
    total, moved, turned = loss + lasso @ np.abs(x), [], []
    for _ in range(rounds):
        down, up = grad - lasso, grad + lasso
        steep = np.where(x > 0, up, np.where(x < 0, down, np.where(up < 0, up, np.maximum(down, 0))))
        if not steep.any():
            break
        go, shares = -steep, []
        for s, y in zip(reversed(moved), reversed(turned)):
            shares.append(s @ go / (s @ y))
            go = go - shares[-1] * y
        if moved:
            go = go * (moved[-1] @ turned[-1] / (turned[-1] @ turned[-1]))
        for s, y, share in zip(moved, turned, reversed(shares)):
            go = go + s * (share - y @ go / (s @ y))
        go[go * steep >= 0] = 0
        side, step = np.where(x != 0, np.sign(x), -np.sign(steep)), 1.0 if moved else 1 / np.linalg.norm(steep)
        for _ in range(12):
            new = x + step * go
            new[new * side < 0] = 0
            loss, new_grad = slopes(new)
            new_total = loss + lasso @ np.abs(new)
            if new_total <= total + 1e-4 * (steep @ (new - x)):
                break
            step /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            moved, turned = [*moved, s][-memory:], [*turned, y][-memory:]
        x, grad, gain, total = new, new_grad, total - new_total, new_total
        if gain < 1e-4 * total:
            break
    return x


def fit(rows: DataFrame, levels: int = 3, rounds: int = 50, lasso: float = 1e-4) -> Model:
    """Maximum likelihood with a lasso penalty, which leaves chance words at zero. ``rows`` (features array<int>, grade int) is a
    written table of bounded size; its tasks add up their parts of the slopes, and the driver holds vectors of ``WIDTH`` numbers at most."""
    spark = rows.sparkSession

    def over(each: Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray]:
        """The sum over the table's tasks of the vectors that ``each`` makes of a task's rows."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = ((b.column(0).flatten().to_numpy(), b.column(0).value_lengths().to_numpy().astype(np.int64), b.column(1).to_numpy().astype(np.int64)) for b in batches)
            yield pa.record_batch([pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in each(parts)], names)

        names = [f"v{k}" for k in range(3)]
        total: list[np.ndarray] = []
        for got in arrow_stage(rows.coalesce(PARTS), task, ", ".join(f"{n} binary" for n in names), rows=PART).collect():  # PARTS rows at most, however the table's files lie
            vectors = [np.frombuffer(x, "<f8") for x in got]
            total = [a + b for a, b in zip(total, vectors)] if total else vectors
        return total

    def counts(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        features, grades, n = np.zeros(WIDTH), np.zeros(levels), 0
        for flat, sizes, own in parts:
            features += np.bincount(flat, minlength=WIDTH)
            grades += np.bincount(own, minlength=levels)
            n += len(sizes)
        return [features, grades, np.array([float(n)])]

    found = over(counts)
    if not found or (found[1] > 0).sum() < 2:
        raise NoGrades("labels of at least two grades are needed")
    names, n = np.flatnonzero(found[0] >= MIN_DOCS), found[2][0]
    del found

    named = spark.sparkContext.broadcast(names.astype(np.int32))  # WIDTH numbers at most, as are a step's

    def slopes(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((x[: len(names)].astype(np.float32), x[len(names) :]))

        def each(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
            (own, free), names, weights = shared.value, named.value, np.zeros(WIDTH, np.float32)
            weights[names] = own
            loss, by_weight, by_free = part_of(Model(weights, thresholds_of(free)), free, parts)
            return [np.array([loss]), by_weight[names], by_free]

        loss, by_weight, by_free = over(each)
        shared.destroy()
        return loss[0] / n, np.concatenate((by_weight, by_free)) / n

    x, penalty = np.zeros(len(names) + levels - 1), np.full(len(names) + levels - 1, lasso * np.sqrt(PENALTY_ROWS / n))  # fewer rows leave more to chance
    x[len(names)], penalty[len(names) :] = -1.0, 0.0
    x = least(slopes, x, penalty, rounds)
    named.destroy()
    weights = np.zeros(WIDTH, np.float32)
    weights[names] = x[: len(names)]
    return Model(weights, thresholds_of(x[len(names) :]))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, text, grade of at most ``max_labelled`` labelled documents."""
    graded = (
        labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.when(F.max("toxic") == 1, 0).when(F.min("quality") == 0, 1).otherwise(2).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    return docs.select("doc_id", "text").join(F.broadcast(graded), "doc_id").dropDuplicates(["doc_id"])  # max_labelled rows at most


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Model:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([make.of(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32())), batch.column(2)], ["doc_id", "features", "grade"])

    rows = labelled_rows(docs, labels, max_labelled).select("doc_id", "text", F.col("grade").cast("int").alias("grade"))
    # max_labelled rows at most, so a bounded table, dealt out by id; the slopes are added up over its parts
    made = arrow_stage(rows, each, "doc_id long, features array<int>, grade int").repartition(PARTS, "doc_id").select("features", "grade")
    made = cut(made, "labelled")
    try:
        return fit(made)
    finally:
        drop_cut(made)


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Model | None:
    """The model, or None where the labelled documents are not of two grades at least."""
    try:
        return train(docs, labels, max_labelled)
    except NoGrades:
        return None


def grade(docs: DataFrame, model: Model | None, keep_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, tail_probability and keep; without a model the first two are null and any text with words is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.thresholds))  # WIDTH numbers
    names = [free_name(docs, n) for n in ("expected_grade", "tail_probability", "keep")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Model(*shared.value)
        make = Features(own.weights != 0) if own else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            words = np.array([bool(t) and not t.isspace() for t in texts], dtype=bool)
            if own:
                expected, tail = own.grades(np.array([float(own.weights[make.of(t or "")].sum()) for t in texts]))
                found = [pa.array(expected), pa.array(tail), pa.array((tail >= keep_at) & words)]
            else:
                found = [pa.nulls(len(texts), pa.float64()), pa.nulls(len(texts), pa.float64()), pa.array(words)]
            yield pa.record_batch([*batch.columns, *found], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_stage(docs, each, f"{schema}, {names[0]} double, {names[1]} double, {names[2]} boolean")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, fitted(docs, table(spark, sf_dir, "labels"))).drop("text")
