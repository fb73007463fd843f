"""Alignment of two sequences: edit scripts, distances and similarity, as plain functions, a table function and column
functions. Ties between equally short scripts go to the leftmost: equal before replace before delete before insert."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# workers import this module too, where no session could parse a type from a string
SCRIPT = T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(x, T.IntegerType()) for x in ("a0", "a1", "b0", "b1"))])
#: Cells of a table that is kept whole.
CELLS = 4_000_000
COUNTS = T.StructType([T.StructField(x, T.LongType()) for x in ("errors", "matched", "replaced", "deleted", "inserted")])


def opcodes(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    """The least edit script as runs (tag, a0, a1, b0, b1); equal ends are cut off before the table is filled.
    Of a table of more than ``CELLS`` only some rows are kept; those between them are filled again as the script comes to them."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = list(a[head : n - tail]), list(b[head : m - tail])
    names: dict = {}
    xs = np.array([names.setdefault(v, len(names)) for v in x], dtype=np.int64)
    ys = np.array([names.setdefault(v, len(names)) for v in y], dtype=np.int64)
    steps = np.arange(len(y) + 1)

    def above(row: np.ndarray, i: int) -> np.ndarray:
        """Costs of the rests from (i, j), from those of i + 1."""
        best = row + 1
        best[:-1] = np.minimum(best[:-1], row[1:] + (ys != xs[i]))
        # inserts: a running minimum from the right
        return np.minimum.accumulate((best + steps)[::-1])[::-1] - steps

    every = 1 if (len(x) + 1) * (len(y) + 1) <= CELLS else isqrt(len(x)) + 1
    row = np.arange(len(y), -1, -1)
    cost = {len(x): row}
    for i in range(len(x) - 1, -1, -1):
        row = above(row, i)
        if i % every == 0:
            cost[i] = row
    out: list[list] = [["equal", 0, head, 0, head]] if head else []
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and i + 1 not in cost:
            upto = min(len(x), (i // every + 1) * every)
            for k in range(upto - 1, i, -1):
                cost[k] = above(cost[k + 1], k)
        if i < len(x) and j < len(y) and cost[i][j] == cost[i + 1][j + 1] + (x[i] != y[j]):
            tag, di, dj = ("equal" if x[i] == y[j] else "replace"), 1, 1
        elif i < len(x) and cost[i][j] == cost[i + 1][j] + 1:
            tag, di, dj = "delete", 1, 0
        else:
            tag, di, dj = "insert", 0, 1
        if out and out[-1][0] == tag:
            out[-1][2] += di
            out[-1][4] += dj
        else:
            out.append([tag, head + i, head + i + di, head + j, head + j + dj])
        if di and every > 1:
            del cost[i]
        i, j = i + di, j + dj
    if tail:
        if out and out[-1][0] == "equal":
            out[-1][2], out[-1][4] = n, m
        else:
            out.append(["equal", n - tail, n, m - tail, m])
    return [tuple(o) for o in out]


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, the bits of an integer at a time."""
    at: dict = {}
    for i, v in enumerate(a):
        at[v] = at.get(v, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for v in b:
        hit = row & at.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance, the bits of an integer at a time (Myers 1999, Hyyro 2003)."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    at: dict = {}
    for i, v in enumerate(a):
        at[v] = at.get(v, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for v in b:
        hit = at.get(v, 0)
        diagonal = ((((hit & plus) + plus) ^ plus) | hit | minus) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return score


def ratio(a: Sequence, b: Sequence) -> float:
    """Similarity from 0 to 100 by insertions and deletions alone."""
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with an equally long stretch of the longer."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[k : k + len(a)]) for k in range(len(b) - len(a) + 1))


@udtf(returnType=SCRIPT)
class Align:
    """LATERAL align(a, b): rows of the edit script of two arrays of strings."""

    def eval(self, a: list[str], b: list[str]):
        yield from opcodes(a or [], b or [])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(COUNTS)
def script_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many elements each part of the edit script of two arrays (or strings) holds."""
    rows = []
    for x, y in zip(a, b):
        n = {"equal": 0, "replace": 0, "delete": 0, "insert": 0}
        for tag, a0, a1, b0, b1 in opcodes(x if x is not None else [], y if y is not None else []):
            n[tag] += max(a1 - a0, b1 - b0)
        rows.append((n["replace"] + n["delete"] + n["insert"], n["equal"], n["replace"], n["delete"], n["insert"]))
    return pd.DataFrame(rows, columns=["errors", "matched", "replaced", "deleted", "inserted"])


@F.pandas_udf(T.LongType())
def distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distances of two columns of strings, or of arrays of words."""
    return pd.Series([distance(x if x is not None else "", y if y is not None else "") for x, y in zip(a, b)], dtype="int64")
