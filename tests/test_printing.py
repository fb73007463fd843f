"""Dashes, ellipses, numbers and boxes against hand-made cases and plain versions."""

import itertools
import statistics

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions.typography import blanks_styled, dashes_styled, ellipses_styled, ellipsis_style
from quire.operators.layout import margin_skew, visual_lines, words_in_lines

NBSP = " "


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_dashes(spark):
    texts = ["he said—well -- yes", "1914–1918 and 1914 – 1918", "at –5 or 7—x", "“— so —” he", "wat -, maar", "end—", "—start", "he – ’s avonds", "a - b, well-known", None]
    want = [f"he said{NBSP}– well{NBSP}– yes", "1914–1918 and 1914 – 1918", "at –5 or 7—x", f"“– so{NBSP}–” he", f"wat{NBSP}–, maar", f"end{NBSP}–", "– start", f"he{NBSP}– ’s avonds", f"a{NBSP}– b, well-known", None]
    assert one(spark, dashes_styled("t", "–", "word"), *texts) == want


def test_ellipses(spark):
    texts = ["so ... then…", "so. . . . then", "why? ... I", "“... I", "he left.’ ... then", "four.... dots", "now. ... Oh", None]
    tight = ["so… then…", "so. . . . then", f"why?{NBSP}… I", "“… I", f"he left.’{NBSP}… then", "four.... dots", "now. ... Oh", None]
    assert one(spark, ellipses_styled("t", "…"), *texts)[:6] == tight[:6]
    spaced = f".{NBSP}.{NBSP}."
    four = f".{NBSP}{spaced}"
    got = one(spark, ellipses_styled("t", ". . .", True), *texts)
    assert got[0] == f"so{NBSP}{spaced} then{NBSP}{spaced}" and got[1] == f"so{four} then" and got[6] == f"now{four} Oh"
    assert one(spark, blanks_styled("t", "——"), "Mr ____ of _") == ["Mr —— of ——"]


@pytest.mark.parametrize("line, times, want", [("so... then", 12, ("...", False)), ("so . . . then", 12, (". . .", True)), ("so… then", 12, ("…", False)), ("so … then", 9, (None, None)), ("now. . . . Oh", 12, (". . .", True))])
def test_ellipsis_style(spark, line, times, want):
    rows = spark.createDataFrame([("b", line)] * times, "book string, text string")
    assert tuple(ellipsis_style(rows, "book").select("form", "space_before").first()) == want


def test_numbers(spark):
    n = spark.range(1, 4000).select("id", N.roman("id").alias("r"), *[N.word_value(N.in_words("id", k)).alias(k) for k in ("en", "nl")])
    assert n.where(~N.roman_value("r").eqNullSafe(F.col("id").cast("int"))).count() == 0
    assert n.where("id < 100 AND (en <> id OR nl <> id) OR id >= 100 AND en IS NOT NULL").count() == 0
    assert one(spark, N.in_words(F.lit(22), "nl"), "x") == ["tweeëntwintig"]
    assert one(spark, N.word_value("t"), "ZEVEN.", "Twenty two", "tweeentwintig", "none", None) == [7, 22, 22, None, None]
    assert one(spark, N.near_number_word("t"), "LEVEN", "VERANTWOORDING") == [True, False]
    assert one(spark, N.roman_value("t"), "IIX", "", "iv", "Ill", None) == [None, None, 4, None, None]
    assert one(spark, N.bare_numeral("t"), "Ill.", "XIV", "Then", " ") == ["III", "XIV", None, None]
    assert one(spark, N.trailing_numeral("t"), "CHAPTER XII.", "The end") == ["XII", ""]
    assert one(spark, N.number_lookalike("t"), "Io", "1234", "II", "Ix") == [True, False, True, False]
    assert one(spark, N.reads_as_folio("t", F.lit(23)), "28", "23.", "5", "2x", "Z3", "l3", None) == [True, True, False, False, False, True, None]
    assert one(spark, N.title_key("t"), "12 The End, 13.", "Chapter 2", "7") == ["THEEND", "CHAPTER2", ""]
    assert one(spark, N.title_key("t", F.lit(12)), "l2 Animal II", "CHAPTER XL1I. 13", "3 Men 12.", "12", "Hoofdstuk 12", None) == ["ANIMAL", "CHAPTERXL1I", "3MEN", "", "HOOFDSTUK12", None]
    assert one(spark, N.label_number("t"), "» Chapter 12.", "Part of 3", "Boek: 4") == ["12", "", "4"]


def test_lines_and_words(spark):
    boxes = [("7", 0.0, 0.0, 5.0, 10.0), ("Once", 100.0, 1.0, 140.0, 11.0), ("upon", 150.0, -1.0, 190.0, 9.0), ("a", 100.0, 14.0, 108.0, 24.0), ("time", 112.0, 16.0, 150.0, 26.0)]
    rows = spark.createDataFrame([(1, *b) for b in boxes], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = visual_lines(rows, ["page"])
    assert [r.text for r in lines.orderBy("line").collect()] == ["7", "Once upon", "a time"]
    held = words_in_lines(rows, lines, ["page"], "text").collect()
    assert {r.text: r.line for r in held} == {"7": 0, "Once": 1, "upon": 1, "a": 2, "time": 2}
    assert visual_lines(rows.limit(0), ["page"]).count() == 0


def test_margin_skew(spark):
    ends = [(10.0 * i, 300 + 0.01 * i + (i % 3) * 0.1) for i in range(20)] + [(205.0, 120.0), (215.0, 340.0)]
    rows = spark.createDataFrame([(1, y, y, x) for y, x in ends], "page int, y0 double, y1 double, x1 double")
    full = ends[:20]
    right = max(x for _, x in full)
    want = statistics.median((b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(full, 2))
    got = margin_skew(rows, ["page"]).first()
    assert got.right_margin == right and got.n_full == 20 and abs(got.slope - want) < 1e-9
