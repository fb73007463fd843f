"""How books print: dashes and ellipses, numbers in words and letters, folios, titles; boxes put together to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.typography import dashes_styled, ellipses_styled, ellipsis_style
from ..functions.text import c
from ..operators.layout import margin_skew, visual_lines, words_in_lines
from ..registry import query
from ..sources.tables import LINES_SQL, lines, table


def _undigited(x):
    return F.translate(c(x), "0123456789-", "")


@query(
    r"""SELECT doc_id, md5(regexp_replace(t, '\s*(?:[—–]|--)\s*', '—', 'g')) AS styled, md5(regexp_replace(replace(t, ', ', '…'), '—', '--', 'g')) AS other
    FROM (SELECT doc_id, replace(translate(text, '0123456789-', ''), ', ', CASE WHEN doc_id % 2 = 0 THEN ' -- ' ELSE '—' END) AS t FROM documents)"""
)
def dashes_in_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes read in two ways are set in one."""
    read = F.replace(_undigited("text"), F.lit(", "), F.when(F.col("doc_id") % 2 == 0, " -- ").otherwise("—"))
    d = table(spark, sf_dir, "documents").select("doc_id", read.alias("t"))
    other = F.replace(F.replace("t", F.lit(", "), F.lit("…")), F.lit("—"), F.lit("--"))
    return d.select("doc_id", F.md5(dashes_styled("t")).alias("styled"), F.md5(other).alias("other"))


@query(
    """WITH t AS (SELECT source, doc_id, replace(replace(text, '.', ''), ', ', CASE WHEN doc_id % 4 = 0 THEN '… ' ELSE ' . . . ' END) AS t,
      (length(text) - length(replace(text, ', ', ''))) // 2 AS k FROM documents),
    n AS (SELECT source, sum(CASE WHEN doc_id % 4 = 0 THEN k ELSE 0 END) AS glyphs, sum(CASE WHEN doc_id % 4 <> 0 THEN k ELSE 0 END) AS dots FROM t GROUP BY source)
    SELECT source, CAST(glyphs + dots AS BIGINT) AS n, CASE WHEN glyphs + dots < 10 THEN NULL WHEN glyphs > dots THEN '…' ELSE '. . .' END AS form,
      CASE WHEN glyphs + dots < 10 THEN NULL ELSE glyphs <= dots END AS space_before FROM n"""
)
def ellipsis_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's way of setting an ellipsis, by majority."""
    t = F.replace(F.replace("text", F.lit("."), F.lit("")), F.lit(", "), F.when(F.col("doc_id") % 4 == 0, "… ").otherwise(" . . . "))
    return ellipsis_style(table(spark, sf_dir, "documents").select("source", t.alias("text")), "source")


@query("SELECT doc_id, md5(replace(replace(replace(text, '.', ''), '!', ''), ', ', chr(160) || '… ')) AS styled FROM (SELECT doc_id, replace(text, '?', '') AS text FROM documents)")
def ellipses_in_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.regexp_replace("text", "[.!?]", ""), F.lit(", "), F.lit("... "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ellipses_styled(t, "…", True)).alias("styled"))


@query(
    """SELECT p_partkey, p_size, CAST(p_size AS INTEGER) AS english, CAST(p_size AS INTEGER) AS dutch, true AS near,
    (['','M','MM','MMM'])[1 + p_partkey % 4000 // 1000] || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[1 + p_partkey % 1000 // 100]
      || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[1 + p_partkey % 100 // 10] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[1 + p_partkey % 10] AS roman,
    CASE WHEN p_partkey % 4000 > 0 THEN CAST(p_partkey % 4000 AS INTEGER) END AS roman_value FROM part"""
)
def numbers_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in words, and in Roman numerals, are read back; a misread letter stays near."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", N.roman(F.col("p_partkey") % 4000).alias("roman"))
    english, dutch = N.in_words("p_size", "en"), F.upper(N.in_words("p_size", "nl"))
    near = N.near_number_word(F.concat(F.lit("q"), F.expr("substring(written, 2)")))
    p = p.withColumn("written", english)
    return p.select("p_partkey", "p_size", N.word_value("written").alias("english"), N.word_value(F.concat(dutch, F.lit("."))).alias("dutch"), near.alias("near"), "roman", N.roman_value("roman").alias("roman_value"))


@query(
    """WITH w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN translate(CAST(event_id AS VARCHAR), '10', 'lO') || '.' WHEN 1 THEN CAST(event_id + 3 AS VARCHAR) ELSE 'p' || event_id END AS word, CAST(event_id AS VARCHAR) AS folio FROM events),
    r AS (SELECT event_id, word, folio, translate(rtrim(word, '.'), 'IlOo', '1100') AS t FROM w)
    SELECT event_id, word, regexp_matches(t, '^[0-9]+$') AND (t = folio OR length(folio) >= 2 AND length(t) = length(folio)
      AND len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) <> substr(folio, i, 1))) = 1) AS reads, regexp_matches(word, '^[0-9]+[.]?$') AS any_number, regexp_matches(t, '^[0-9]{1,3}$') AS lookalike FROM r"""
)
def folio_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words at a page's edge against its printed number: letters for digits, and one digit misread."""
    n = F.col("event_id").cast("string")
    word = F.when(F.col("event_id") % 3 == 0, F.concat(F.translate(n, "10", "lO"), F.lit("."))).when(F.col("event_id") % 3 == 1, (F.col("event_id") + 3).cast("string")).otherwise(F.concat(F.lit("p"), n))
    e = table(spark, sf_dir, "events").select("event_id", word.alias("word"))
    return e.select("event_id", "word", N.reads_as_folio("word", "event_id").alias("reads"), N.reads_as_folio("word", F.lit(None)).alias("any_number"), N.number_lookalike("word").alias("lookalike"))


@query(
    rf"""WITH {LINES_SQL}, t AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS n, text FROM lines WHERE line = 0 AND NOT regexp_matches(text, '^\s*[.,]*[0-9]|[0-9][.,]*\s*$|(?i)\b(chapter|part|book|hoofdstuk|deel|boek)\b'))
    SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS key FROM t"""
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's first line, with the page number put before or after it and found again; letters and digits alone."""
    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(n, F.lit(". "), "text")).otherwise(F.concat("text", F.lit(" "), n, F.lit(",")))
    plain = ~F.col("text").rlike(r"^\s*[.,]*[0-9]|[0-9][.,]*\s*$|(?i)\b(chapter|part|book|hoofdstuk|deel|boek)\b")
    return lines(table(spark, sf_dir, "documents")).where((F.col("line") == 0) & plain).select("doc_id", N.title_key(text, "doc_id").alias("key"))


def fragments(docs: DataFrame) -> DataFrame:
    """Words of each line as boxes: eight points a letter, lines sixteen apart, each box up to three points off its line."""
    words = lines(docs).select("doc_id", "line", F.posexplode(F.split("text", " ")).alias("n", "text"))
    off = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "line", "n")), 1, 4), 16, 10).cast("long"), F.lit(4)).cast("double")
    y = 16.0 * F.col("line") + off
    return words.where("text <> ''").select("doc_id", F.col("line").alias("printed"), "n", "text", (100.0 * F.col("n")).alias("x0"), y.alias("y0"), (100.0 * F.col("n") + 98).alias("x1"), (y + 10).alias("y1"))


@query(
    f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM lines)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS line, md5(array_to_string(ws, ' ')) AS text_md5 FROM w WHERE len(ws) > 0"""
)
def lines_from_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of words that wander up and down are put together to the lines they were."""
    made = visual_lines(fragments(table(spark, sf_dir, "documents")), ["doc_id"])
    return made.select("doc_id", "line", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, unnest(string_split(text, ' ')) AS word FROM lines)
    SELECT doc_id, line, count(*) AS n_words FROM w WHERE word <> '' GROUP BY doc_id, line"""
)
def words_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the line whose box holds their centre, though the boxes of neighbouring lines overlap."""
    f = fragments(table(spark, sf_dir, "documents")).withColumn("word", F.concat_ws(":", "printed", "n"))
    boxes = f.groupBy("doc_id", F.col("printed").alias("line")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), (16.0 * F.first("printed") - 4).alias("y0"), (16.0 * F.first("printed") + 17).alias("y1"))
    return words_in_lines(f, boxes, ["doc_id"], "word").groupBy("doc_id", "line").agg(F.count("*").alias("n_words"))


@query(
    f"""WITH {LINES_SQL}, l AS (SELECT doc_id, line // 40 AS page, 16.0::DOUBLE * (line % 40) + 8 AS y, CAST(length(text) // 8 AS DOUBLE) + (line % 40) / 64.0::DOUBLE AS x FROM lines WHERE text <> ''),
    r AS (SELECT a.doc_id, a.page, a.x FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.x - b.x) < 3 GROUP BY a.doc_id, a.page, a.x, a.y HAVING count(*) >= 4),
    m AS (SELECT doc_id, page, max(x) AS right_margin FROM r GROUP BY doc_id, page), f AS (SELECT l.*, right_margin FROM l JOIN m USING (doc_id, page) WHERE abs(x - right_margin) < 3),
    s AS (SELECT a.doc_id, a.page, median((b.x - a.x) / (b.y - a.y)) AS slope FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.page = b.page AND b.y - a.y > 1 GROUP BY a.doc_id, a.page)
    SELECT f.doc_id, f.page, round(any_value(right_margin), 5) AS right_margin, count(*) AS n_full, round(coalesce(any_value(slope), 0), 5) AS slope FROM f LEFT JOIN s ON s.doc_id = f.doc_id AND s.page = f.page GROUP BY f.doc_id, f.page"""
)
def margin_skews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right margin of pages of forty lines, and how it leans."""
    at = F.col("line") % 40
    y = 16.0 * at + 8
    x = F.expr("length(text) div 8").cast("double") + at / 64
    rows = lines(table(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", F.expr("line div 40").alias("page"), y.alias("y0"), y.alias("y1"), x.alias("x1"))
    return margin_skew(rows, ["doc_id", "page"]).select("doc_id", "page", F.round("right_margin", 5).alias("right_margin"), "n_full", F.round("slope", 5).alias("slope"))
