"""Personal data by candidate gradient boosting, on native expressions only.

Four base kinds are found by fixed patterns and checks and always stay. Beside them, high-recall generators propose further
spans, which may overlap each other and the base ones: obscured addresses, local phone numbers, national ids,
account numbers, IBANs, IPv6. Boosted trees score each from its format (length, digits, separators, checksums,
neighbouring characters) and context (words before it); a threshold for each kind, calibrated on held-out labelled
candidates, selects those that are added. The trees are trained here, on ``LABELLED`` generated sentences with known
spans (a fixed seed, so the same model everywhere), and run as SQL expressions within the plan.

Patterns are guarded (possessive runs, no start inside a run) so that a long run of digits or letters costs linear time.

Edge cases: a null text counts as empty and redaction keeps it null; an empty text has no spans (hash of the
empty string); overlapping added spans all stay in ``spans`` and are redacted once; null ids and repeated
rows stay; an empty table gives an empty result; ``spans_of`` needs only the text.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_for_null, free_name, table

#: Labelled sentences generated for training and calibration; trees, their depth and step.
LABELLED, TREES, DEPTH, STEP = 2400, 40, 3, 0.3
#: Precision that a kind's threshold must reach on held-out candidates.
PRECISION = 0.98

#: (kind, pattern); in the order in which spans with one start are listed.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
WIDE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[][aA][tT][)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[][dD][oO][tT][)\]]|\.)\x20?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("account", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){7,}+"),
)
KINDS = [k for k, _ in BASE] + ["national_id", "iban", "ipv6", "account"]
#: A text without any of these has no match of any pattern.
ANY = r"[0-9@]|[(\[][aA][tT][)\]]"
#: Words that speak for personal data, or against it, shortly before a candidate.
FOR = r"(?i)\b(?:call|tel|phone|telefon|mobile|fax|ssn|social|security|iban|account|konto|cuenta|compte|mail|contact|reach|passport|born)\b"
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|token|hash|sha|serial|page|pages|year|years|items|total|build|part|ticket|range)\b"
NEAR = 28
FEATURES = ("f_kind", "f_length", "f_digits", "f_letters", "f_marks", "f_distinct", "f_luhn", "f_for", "f_against", "f_before", "f_after", "f_year", "f_iban", "f_groups")


def found(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, v>>: leftmost matches that do not overlap, in code points."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""aggregate(
      arrays_zip(slice(split({text}, '{p}', -1), 1, size(regexp_extract_all({text}, '{p}', 0))), regexp_extract_all({text}, '{p}', 0)),
      named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,v:string>>)),
      (a, x) -> named_struct('at', a.at + length(x['0']) + length(x['1']),
        'out', concat(a.out, array(named_struct('s', a.at + length(x['0']), 'e', a.at + length(x['0']) + length(x['1']), 'v', x['1'])))),
      a -> a.out)"""


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(v: str) -> str:
    """SQL: do the digits of ``v`` pass? Every second digit from the right is doubled."""
    return f"""aggregate(filter(split(reverse({digits(v)}), ''), d -> d <> ''), named_struct('t', 0, 'odd', true),
      (a, d) -> named_struct('t', a.t + IF(a.odd, int(d), int(d) * 2 - IF(int(d) > 4, 9, 0)), 'odd', NOT a.odd), a -> a.t % 10 = 0)"""


CHECK = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"length({digits('x.v')}) BETWEEN 12 AND 19 AND {luhn('x.v')}",
    "phone": f"length({digits('x.v')}) BETWEEN 9 AND 15",
}


def base_spans(text: str) -> str:
    """SQL: the checked spans of the four base kinds as array<struct<s, k, kind, e>>, in order."""
    each = [f"transform(filter({found(text, p)}, x -> {CHECK[kind]}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))" for k, (kind, p) in enumerate(BASE)]
    return f"array_sort(concat({', '.join(each)}))"


def candidates(text: str, base: str) -> str:
    """SQL: what the generators propose, with features; spans that lie within a base span are left out."""
    each = [f"transform({found(text, p)}, x -> named_struct('s', x.s, 'k', {KINDS.index(kind)}, 'e', x.e, 'v', x.v))" for kind, p in WIDE]
    outside = f"filter(concat({', '.join(each)}), x -> NOT exists({base}, b -> b.s <= x.s AND b.e >= x.e))"
    before = f"substring({text}, greatest(1, x.s + 1 - {NEAR}), least({NEAR}, x.s))"
    return f"""transform({outside}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e,
      'f_kind', double(x.k), 'f_length', double(length(x.v)), 'f_digits', double(length({digits("x.v")})),
      'f_letters', double(length(regexp_replace(x.v, '[^A-Za-z]', ''))), 'f_marks', double(length(regexp_replace(x.v, '[A-Za-z0-9]', ''))),
      'f_distinct', double(size(array_distinct(split({digits("x.v")}, '')))), 'f_luhn', IF({luhn("x.v")}, 1D, 0D),
      'f_for', IF({before} rlike r'{FOR}', 1D, 0D), 'f_against', IF({before} rlike r'{AGAINST}', 1D, 0D),
      'f_before', IF({before} rlike '[A-Za-z0-9"=.]$', 1D, 0D), 'f_after', IF(substring({text}, x.e + 1, 1) rlike '[A-Za-z0-9"]', 1D, 0D),
      'f_year', IF(x.v rlike '(?:19|20)[0-9]{{2}}', 1D, 0D), 'f_iban', IF(x.v rlike '^[A-Z]{{2}}[0-9]{{2}}', 1D, 0D),
      'f_groups', double(size(split(x.v, '[^A-Za-z0-9]+')))))"""


# ---- labelled sentences -------------------------------------------------------------------------------------------


def labelled(n: int = LABELLED, seed: int = 11) -> list[dict]:
    """Sentences with at most one span each: ``text``, ``s``, ``e``, and whether it is personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "ti", "on", "re", "sh", "ou", "la", "de", "en")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    far = lambda k: " ".join(word() for _ in range(k))

    def phone():
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}"))

    def iban():
        groups = " ".join([r.choice("DEFRESNL") + r.choice("DEFRESNL") + num(2), *(num(4) for _ in range(r.randint(4, 5))), num(2)])
        return groups if r.random() < 0.5 else groups.replace(" ", "")

    good = (
        (("call", "tel", "phone", "fax"), phone),
        (("ssn", "social security"), lambda: f"{num(3)}-{num(2)}-{num(4)}"),
        (("iban", "account", "konto"), iban),
        (("contact", "reach"), lambda: f"{word()} [at] {word()} [dot] com" if r.random() < 0.5 else f"{word()}(at){word()}.org"),
        (("account", "cuenta", "compte", "passport"), lambda: num(r.randint(8, 12))),
        (("contact", "security"), lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8))),
    )
    bad = (
        (("order", "invoice", "ticket"), lambda: f"{num(4)} {num(4)} {num(4)}"),
        (("version", "build"), lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        (("isbn",), lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"),
        (("part", "serial"), lambda: f"{num(3)}-{num(2)}-{num(4)}"),
        (("token", "sha", "hash"), lambda: '= "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'),
        (("total", "items", "range"), lambda: f"{num(3)} {num(3)} {num(3)}"),
        (("years", "pages", "year"), lambda: f"19{num(2)}-20{num(2)}"),
        (("serial", "part"), lambda: r.choice("AB") + r.choice("XY") + num(2) + "".join(r.choice("ABCDEFGH0123456789") for _ in range(16))),
        ((), lambda: num(r.choice((8, 10, 12, 16, 16, 16)))),
        ((), lambda: f"{num(3)} {num(3)} {num(4)}"),
    )
    out = []
    for i in range(n):
        words, make = r.choice(good) if i % 2 else r.choice(bad)
        head = far(r.randint(2, 6)) + " " + (r.choice(words) + " " if words else "")
        v = make()
        out.append({"text": head + v + " " + far(r.randint(1, 4)), "s": len(head), "e": len(head) + len(v), "good": i % 2})
    return out


# ---- boosted trees ------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple:
    """A regression tree by Newton gain: (feature, threshold, left, right) or (value,)."""
    g, h = grad.sum(), hess.sum()
    leaf = (float(g / (h + 1.0)),)
    if depth == 0 or len(x) < 8:
        return leaf
    best, split = 1e-6, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cg, ch = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = np.where(v[1:] > v[:-1], cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1), -1)
        if len(gain) and gain.max() > best:
            best, at = gain.max(), int(gain.argmax())
            split = (f, float((v[at] + v[at + 1]) / 2))
    if split is None:
        return leaf
    left = x[:, split[0]] <= split[1]
    return (*split, grow(x[left], grad[left], hess[left], depth - 1), grow(x[~left], grad[~left], hess[~left], depth - 1))


def value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], value(tree[2], x), value(tree[3], x))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    score, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(grow(x, y - p, p * (1 - p), depth))
        score += STEP * value(out[-1], x)
    return out


def as_sql(tree: tuple, row: str = "c") -> str:
    if len(tree) == 1:
        return f"{STEP * tree[0]:.12f}D"
    return f"IF({row}.{FEATURES[tree[0]]} <= {tree[1]!r}D, {as_sql(tree[2], row)}, {as_sql(tree[3], row)})"


def thresholds(kind: np.ndarray, score: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> dict[int, float]:
    """For each kind the least score from which on held-out precision is reached; none: nothing is added."""
    out = {}
    for k in range(len(BASE) + 4):
        s, t = score[kind == k], y[kind == k]
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
        ok = np.flatnonzero((good >= precision) & (np.append(s[order][1:], -np.inf) < s[order]))
        if len(ok):
            out[k] = max(0.0, float(s[order][ok[-1]]))
    return out


@functools.cache
def model(spark: SparkSession) -> tuple[list[tuple], dict[int, float], float]:
    """Trees, thresholds and held-out accuracy. Candidates of the labelled sentences are found and described by
    the same expressions that serve the corpus; half of the sentences train, half calibrate."""
    rows = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(labelled())), "array<struct<text:string,s:int,e:int,good:int>>")).alias("r")).select("r.*")
    rows = rows.withColumn("base", F.expr(base_spans("text"))).withColumn("c", F.explode(F.expr(candidates("text", "base"))))
    got = rows.orderBy("text", "c.s", "c.k").select("text", "s", "e", "good", "c").collect()  # LABELLED sentences give a few candidates each
    x = np.array([[r["c"][f] for f in FEATURES] for r in got])
    inside = np.array([min(r["e"], r["c"]["e"]) - max(r["s"], r["c"]["s"]) >= 0.8 * (r["e"] - r["s"]) for r in got])
    y = (inside & np.array([r["good"] == 1 for r in got])).astype(float)
    train = np.arange(len(x)) % 2 == 0
    trees = boosted(x[train], y[train])
    score = sum(STEP * value(t, x[~train]) for t in trees)
    cuts = thresholds(x[~train, 0].astype(int), score, y[~train])
    return trees, cuts, float(((score > 0) == (y[~train] > 0)).mean())


# ---- the operator -------------------------------------------------------------------------------------------------


def spans_of(docs: DataFrame, text_col: str = "text", base_as: str = "base", all_as: str = "spans") -> DataFrame:
    """``docs`` with two arrays of struct<s, k, e> (start, index into KINDS, end), each in order."""
    trees, cuts, _ = model(docs.sparkSession)
    text = free_name(docs, "whole_text")
    base = free_name(docs, "base_spans")
    none = "cast(array() as array<struct<s:int,k:int,e:int>>)"
    score = " + ".join(as_sql(t) for t in trees)
    limit = "CASE " + " ".join(f"WHEN c.k = {k} THEN {v!r}D" for k, v in cuts.items()) + " ELSE double('Infinity') END"
    added = f"transform(filter({candidates(text, base)}, c -> ({score}) >= {limit}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))"
    some = f"{text} rlike r'{ANY}'"
    out = docs.withColumn(text, empty_for_null(text_col)).withColumn(base, F.expr(f"CASE WHEN {some} THEN {base_spans(text)} ELSE {none} END"))
    out = out.withColumn(free_name(out, "more"), F.expr(f"CASE WHEN {some} THEN array_sort(array_distinct(concat({base}, {added}))) ELSE {none} END"))
    more = out.columns[-1]
    return out.select(*docs.columns, F.col(base).alias(base_as), F.col(more).alias(all_as))


def listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one."""
    spans, base = free_name(docs, "all_spans"), free_name(docs, "some_spans")
    out = spans_of(docs, text_col, base, spans)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    text = f"`{text_col}`"
    new = f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate({spans}, named_struct('at', 0, 'out', ''),
      (a, x) -> IF(x.s >= a.at,
        named_struct('at', x.e, 'out', concat(a.out, substring({text}, a.at + 1, x.s - a.at), element_at({names}, x.k + 1))),
        named_struct('at', greatest(a.at, x.e), 'out', a.out)),
      a -> concat(a.out, substring({text}, a.at + 1))) END"""
    return out.withColumn(text_col, F.expr(new)).select(*docs.columns)


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found_in = spans_of(docs)
    # as SQL: a second parameter of a Python lambda, even with a default, would be the element's index
    count = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{kind}") for k, (kind, _) in enumerate(BASE)]
    return found_in.select("doc_id", *count, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
