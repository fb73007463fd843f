"""Pages and their lines: statistics, edges, repeats, gaps, roles of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.align import ratio
from ..functions.text import garbled, word_count, words
from ..registry import query
from ..sources.tables import LINES_SQL, READINGS_SQL, html_blocks, lines, readings, table

REPEAT_WINDOW, REPEAT_MIN_CHARS, REPEAT_SAME = 12, 200, 90
GAP_HOLD, GAP_RETURN, MAX_GAP = 3, 12, 32


@query(f"WITH {LINES_SQL} SELECT doc_id, line, text FROM lines")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "line", "text")


@query(
    f"""WITH {LINES_SQL} SELECT lang, count(*) AS n_lines, count(DISTINCT doc_id) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars,
    CAST(max(length(text)) AS BIGINT) AS longest, round(avg(length(text)), 6) AS mean_chars FROM lines GROUP BY lang"""
)
def line_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return lines(table(spark, sf_dir, "documents")).groupBy("lang").agg(
        F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_pages"), F.sum(n).alias("n_chars"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean_chars")
    )


def with_edges(rows: DataFrame, first: int = 2, last: int = 3) -> DataFrame:
    """Lines with their rank from both ends of the page, and whether they stand at an edge."""
    page = Window.partitionBy("doc_id")
    n = F.count("*").over(page)
    return rows.withColumn("from_top", F.col("line") + 1).withColumn("from_end", n - F.col("line")).withColumn("edge", (F.col("from_top") <= first) | (F.col("from_end") <= last))


@query(
    f"""WITH {LINES_SQL} SELECT doc_id, line, CASE WHEN line < 2 THEN 'top' ELSE 'foot' END AS edge, text
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) WHERE line < 2 OR n - line <= 3"""
)
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = with_edges(lines(table(spark, sf_dir, "documents"))).where("edge")
    return edges.select("doc_id", "line", F.when(F.col("from_top") <= 2, "top").otherwise("foot").alias("edge"), "text")


@query(
    f"""WITH {LINES_SQL} SELECT text, count(DISTINCT doc_id) AS n_pages, count(DISTINCT source) AS n_books FROM lines
    WHERE line = 0 AND len(list_filter(string_split(text, ' '), lambda x: x <> '')) <= 8 GROUP BY text HAVING count(DISTINCT doc_id) >= 3"""
)
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lines(table(spark, sf_dir, "documents")).where((F.col("line") == 0) & (word_count("text") <= 8))
    return first.groupBy("text").agg(F.countDistinct("doc_id").alias("n_pages"), F.countDistinct("source").alias("n_books")).where("n_pages >= 3")


@query(
    f"""WITH {LINES_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS nth, count(*) OVER (PARTITION BY doc_id, text) AS times FROM lines WHERE text <> '')
    SELECT doc_id, line, nth, times FROM e WHERE times > 1 AND nth > 1"""
)
def inner_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = Window.partitionBy("doc_id", "text")
    rows = lines(table(spark, sf_dir, "documents")).where("text <> ''")
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy("line")).cast("long")).withColumn("times", F.count("*").over(same))
    return rows.where("times > 1 AND nth > 1").select("doc_id", "line", "nth", "times")


@query("SELECT doc_id, original FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS original FROM documents) WHERE doc_id <> original")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    originals = docs.groupBy("key").agg(F.min("doc_id").alias("original"))
    return docs.join(originals, "key").where("doc_id <> original").select("doc_id", "original")


def near_repeats(pages: DataFrame, window: int = REPEAT_WINDOW, least: int = REPEAT_MIN_CHARS, same: float = REPEAT_SAME) -> DataFrame:
    """book, n, m: each page whose text repeats one of the ``window`` before it; a page that is itself a repeat is no original.
    Pages of one book are dealt out in runs with an overlap, so no task holds a book: candidates are found
    by an equi-join on the run, bounded by length, then compared."""
    run = window * 8
    p = pages.where(F.length("text") >= least)
    later = p.select("book", F.col("n"), F.col("text"), F.floor(F.col("n") / run).alias("run"))
    earlier = p.select("book", F.col("n").alias("m"), F.col("text").alias("before"), F.explode(F.array(F.floor(F.col("n") / run), F.floor((F.col("n") + window) / run))).alias("run")).distinct()
    close = later.join(earlier, ["book", "run"]).where(F.col("m").between(F.col("n") - window, F.col("n") - 1))
    # 2 * min / (a + b) bounds the ratio
    a, b = F.length("text"), F.length("before")
    close = close.where(2 * F.least(a, b) * 100 >= same * (a + b))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [ratio(x, y) >= same for x, y in zip(batch["text"], batch["before"])]
            yield batch.loc[hit, ["book", "n", "m"]]

    pairs = close.select("book", "n", "m", "text", "before").mapInPandas(each, "book string, n long, m long")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, int] = {}
        for n, group in rows.sort_values(["n", "m"]).groupby("n", sort=True):
            m = next((m for m in group["m"] if m not in out), None)
            if m is not None:
                out[n] = m
        return pd.DataFrame({"book": [rows["book"].iloc[0]] * len(out), "n": list(out), "m": list(out.values())})

    return pairs.groupBy("book").applyInPandas(settle, "book string, n long, m long")


@query()
def near_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(w).cast("long")).withColumn("book", F.concat_ws("/", "lang", "source"))
    return near_repeats(docs.select("book", "n", "text"))


def page_gaps(numbered: DataFrame, book: str = "book") -> DataFrame:
    """book, before, first_missing, last_missing from (book, pdf, folio) of the pages that carry a number: three
    pages before agree on the offset, three from here agree on another, and none of the next twelve goes back."""
    w = Window.partitionBy(book).orderBy("pdf")
    now = F.col("pdf") - F.col("folio")
    before, after, later = w.rowsBetween(-GAP_HOLD, -1), w.rowsBetween(0, GAP_HOLD - 1), w.rowsBetween(GAP_HOLD, GAP_HOLD + GAP_RETURN - 1)
    rows = numbered.where("folio IS NOT NULL").withColumn("now", now)
    rows = rows.withColumn("was", F.min("now").over(before)).withColumn("was_to", F.max("now").over(before)).withColumn("n_before", F.count("now").over(before))
    rows = rows.withColumn("to", F.min("now").over(after)).withColumn("to_to", F.max("now").over(after)).withColumn("n_after", F.count("now").over(after))
    rows = rows.withColumn("returns", F.coalesce(F.array_contains(F.collect_list("now").over(later), F.col("was")), F.lit(False)))
    held = (F.col("n_before") == GAP_HOLD) & (F.col("n_after") == GAP_HOLD) & (F.col("was") == F.col("was_to")) & (F.col("to") == F.col("to_to"))
    found = rows.where(held & ~F.col("returns") & (F.col("was") - F.col("to")).between(1, MAX_GAP))
    return found.select(book, F.col("pdf").alias("before"), (F.col("pdf") - F.col("was")).alias("first_missing"), (F.col("pdf") - F.col("to") - 1).alias("last_missing"))


@query(
    """WITH p AS (SELECT user_id AS book, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pdf FROM events),
    o AS (SELECT book, pdf, pdf - (pdf + 2 * (pdf // 40)) AS now FROM p WHERE event_type <> 'error'),
    w AS (SELECT *, min(now) OVER b AS was, max(now) OVER b AS was_to, count(now) OVER b AS n_before, min(now) OVER a AS "to", max(now) OVER a AS to_to, count(now) OVER a AS n_after,
      coalesce(list_contains(list(now) OVER l, min(now) OVER b), false) AS returns FROM o
      WINDOW b AS (PARTITION BY book ORDER BY pdf ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY book ORDER BY pdf ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
        l AS (PARTITION BY book ORDER BY pdf ROWS BETWEEN 3 FOLLOWING AND 14 FOLLOWING))
    SELECT book, pdf AS before, pdf - was AS first_missing, pdf - "to" - 1 AS last_missing FROM w
    WHERE n_before = 3 AND n_after = 3 AND was = was_to AND "to" = to_to AND NOT returns AND was - "to" BETWEEN 1 AND 32"""
)
def page_gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").withColumn("pdf", F.row_number().over(w).cast("long"))
    folio = F.when(F.col("event_type") != "error", F.col("pdf") + 2 * F.expr("pdf div 40"))
    return page_gaps(p.select(F.col("user_id").alias("book"), "pdf", folio.alias("folio")))


@query(
    f"""WITH {READINGS_SQL}, s AS (SELECT doc_id, count(*) AS suspects FROM readings WHERE reading <> text GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
    SELECT n.doc_id, n_lines, round(coalesce(suspects, 0) / n_lines, 6) AS rate FROM n LEFT JOIN s USING (doc_id) WHERE n_lines >= 10 AND coalesce(suspects, 0) / n_lines >= 1.0"""
)
def poor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects a line, over pages of ten lines or more: one aggregation, since a reading stands beside its line."""
    rows = readings(lines(table(spark, sf_dir, "documents")))
    counted = rows.groupBy("doc_id").agg(F.countDistinct("line").alias("n_lines"), F.count_if(F.col("reading") != F.col("text")).alias("suspects"))
    rate = F.col("suspects") / F.col("n_lines")
    return counted.where((F.col("n_lines") >= 10) & (rate >= 1.0)).select("doc_id", "n_lines", F.round(rate, 6).alias("rate"))


GARBLED_SQL = r"""len(toks) > 0 AND len(list_filter(toks, lambda x: regexp_matches(x, '^[\p{P}]*\p{L}[\p{L}''’-]*[\p{P}]*$'))) < 0.5 * len(toks)"""


@query(
    rf"""WITH {LINES_SQL}, t AS (SELECT lang, list_filter(string_split(text, ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^[.…—–-]+$')) AS toks FROM lines)
    SELECT lang, count(*) AS n_lines, count(*) FILTER (WHERE {GARBLED_SQL}) AS n_garbled FROM t GROUP BY lang"""
)
def garbled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(garbled("text")).alias("n_garbled"))


@query(
    r"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
    SELECT word, count(*) AS n, count(DISTINCT source) AS n_books FROM w GROUP BY word HAVING count(*) >= 5"""
)
def book_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word"))
    # counted by book first: the map side combines both
    return w.groupBy("word", "source").agg(F.count("*").alias("k")).groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("n_books")).where("n >= 5")


@query(
    f"""WITH {LINES_SQL}, d AS (SELECT lang, text, count(*) AS n, min(doc_id) AS first_doc FROM lines WHERE text <> '' GROUP BY lang, text)
    SELECT lang, text, n, first_doc FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, text) AS r FROM d) WHERE r <= 5"""
)
def commonest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(table(spark, sf_dir, "documents")).where("text <> ''").groupBy("lang", "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "text")
    return d.withColumn("r", F.row_number().over(top)).where("r <= 5").select("lang", "text", "n", "first_doc")


@query(
    f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line, length(text) AS w FROM lines), p AS (SELECT doc_id, median(w) AS mid FROM m GROUP BY doc_id)
    SELECT doc_id, line, CAST(w AS BIGINT) AS width, round(mid, 6) AS page_width, w < 0.6 * mid AS short FROM m JOIN p USING (doc_id)"""
)
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's width against the median of its page."""
    m = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", F.length("text").cast("long").alias("width"))
    mid = m.groupBy("doc_id").agg(F.median("width").alias("mid"))
    return m.join(mid, "doc_id").select("doc_id", "line", "width", F.round("mid", 6).alias("page_width"), (F.col("width") < 0.6 * F.col("mid")).alias("short"))


@query(
    f"""WITH {LINES_SQL}, v AS (SELECT doc_id, line, length(text) AS x FROM lines)
    SELECT doc_id, line, CAST(list_sort(list(x) OVER w)[1 + len(list(x) OVER w) // 4] AS BIGINT) AS margin FROM v
    WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"""
)
def left_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower quartile (an element, not interpolated) of five lines each way."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-5, 5)
    near = F.array_sort(F.collect_list(F.length("text")).over(w))
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", near.alias("near"))
    return rows.select("doc_id", "line", F.expr("near[size(near) div 4]").cast("long").alias("margin"))


@query()
def html_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(table(spark, sf_dir, "pages"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks numbered by the heading they follow, with words of each section."""
    blocks = html_blocks(table(spark, sf_dir, "pages"))
    w = Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.sum(F.col("tag").rlike("^h[1-6]$").cast("int")).over(w)
    return blocks.withColumn("section", heads).groupBy("page_id", "section").agg(F.min_by("text", "block").alias("heading"), F.count("*").alias("n_blocks"), F.sum(F.size(words("text"))).alias("n_words"))
