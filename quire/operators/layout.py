"""Boxes on pages: fragments to lines, words to lines, the skew of a margin. Joins are on the page, so no task needs a book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAME_LINE, NUMBER_APART = 0.5, 3.0
SLACK_X, SLACK_Y = 3.0, 2.0
BANDS = 32.0


def visual_lines(fragments: DataFrame, page: list[str]) -> DataFrame:
    """page, line, text, x0, y0, x1, y1 from fragments (text, x0, y0, x1, y1): a fragment joins the line above its centre
    when half of its height overlaps it, and a bare number far from the rest of its line is a line of its own before it."""
    w = Window.partitionBy(*page).orderBy((F.col("y0") + F.col("y1")) / 2, "x0", "text")
    height = F.col("y1") - F.col("y0")
    below = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joins = F.coalesce(F.least(below, F.col("y1")) - F.col("y0") >= SAME_LINE * height, F.lit(False))
    rows = fragments.withColumn("_joins", joins)
    rows = rows.withColumn("_line", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*page, "_line").orderBy("x0", "text")
    gap_after, gap_before = F.lead("x0").over(across) - F.col("x1"), F.col("x0") - F.lag("x1").over(across)
    first, last = F.lag("x0").over(across).isNull(), F.lead("x0").over(across).isNull()
    far = NUMBER_APART * height
    bare = F.regexp_replace("text", r"^[.,]+|[.,]+$", "").rlike("^[0-9]+$")
    apart = bare & ((first & (gap_after > far)) | (last & (gap_before > far)))
    rows = rows.withColumn("_part", F.when(F.coalesce(apart, F.lit(False)), F.when(first, 0).otherwise(1)).otherwise(2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    lines = rows.groupBy(*page, "_line", "_part").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    order = Window.partitionBy(*page).orderBy("_line", "_part")
    return lines.withColumn("line", F.row_number().over(order).cast("long") - 1).select(*page, "line", "text", "x0", "y0", "x1", "y1")


def words_in_lines(words: DataFrame, lines: DataFrame, page: list[str], word: str) -> DataFrame:
    """page, word, line: each word in the line with the nearest centre of those whose box holds its own centre. Both sides
    are dealt into bands of height, so the join is on equality and a long page makes no square of its lines."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    band = lambda y: F.floor(y / BANDS)
    w = words.select(*page, F.col(word), cx.alias("cx"), cy.alias("cy"), band(cy).alias("_band"))
    top, foot = F.col("y0") - SLACK_Y, F.col("y1") + SLACK_Y
    ln = lines.select(*page, "line", "x0", "x1", top.alias("_top"), foot.alias("_foot"), cy.alias("_mid"), F.explode(F.sequence(band(top), band(foot))).alias("_band"))
    held = w.join(ln, [*page, "_band"]).where(F.col("cx").between(F.col("x0") - SLACK_X, F.col("x1") + SLACK_X) & F.col("cy").between(F.col("_top"), F.col("_foot")))
    # a word (its page and name) has one place and so one band: the band as a key changes nothing, and the join's rows are not sent again
    return held.groupBy(*page, "_band", word).agg(F.min_by("line", F.struct(F.abs(F.col("_mid") - F.col("cy")), "line")).alias("line")).drop("_band")


def margin_skew(lines: DataFrame, page: list[str], slack: float = 3.0, least: int = 4) -> DataFrame:
    """page, right_margin, n_full, slope: the furthest right that ``least`` lines of a page end at within ``slack``, and the
    median slope between the ends of those lines. A page is one printed page: some tens of lines, carried as an array."""
    ends = F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), F.col("x1").alias("x"))))
    p = lines.groupBy(*page).agg(ends.alias("ends"))
    near = lambda a: F.size(F.filter("ends", lambda b: F.abs(b["x"] - a["x"]) < slack))
    p = p.withColumn("right_margin", F.array_max(F.transform(F.filter("ends", lambda a: near(a) >= least), lambda a: a["x"]))).where("right_margin IS NOT NULL")
    p = p.withColumn("full", F.filter("ends", lambda a: F.abs(a["x"] - F.col("right_margin")) < slack))
    slopes = F.flatten(F.transform("full", lambda a: F.transform(F.filter("full", lambda b: b["y"] - a["y"] > 1), lambda b: (b["x"] - a["x"]) / (b["y"] - a["y"]))))
    s = F.array_sort(slopes)
    mid = (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return p.select(*page, "right_margin", F.size("full").cast("long").alias("n_full"), F.coalesce(mid, F.lit(0.0)).alias("slope"))
