"""What readings do to lines, and what lines tell: misreadings that are never the print, stops at line ends, scene breaks,
openings of paragraphs, labels, sunk pages, scores by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import readings as R
from ..registry import query
from ..sources.tables import LINES_SQL, lines, table

#: How far below the usual height, as a share of the page, a sunk page's first line starts.
SUNK = 0.08


def _first_word(x: str = "text"):
    return F.regexp_extract(x, r"[a-z]{3,}", 0)


@query(
    f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, regexp_extract(text, '[a-z]{{3,}}') AS ours FROM lines),
    v AS (SELECT doc_id, line, ours, CASE (doc_id + line) % 4 WHEN 0 THEN replace(ours, 'h', 'b') WHEN 1 THEN replace(ours, 'o', 'oó') WHEN 2 THEN ours || '~' ELSE replace(ours, 'a', 'e') END AS version FROM w WHERE ours <> '')
    SELECT doc_id, line, length(ours) = length(version) AND length(ours) - length(replace(ours, 'h', '')) = 1 AND (doc_id + line) % 4 = 0 AS b_for_h,
      (doc_id + line) % 4 = 1 AND contains(ours, 'o') AS half_accented, (doc_id + line) % 4 = 2 AS unprinted FROM v"""
)
def never_the_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a word that a print never has: one h read as a b, one letter of a doubled vowel accented, a mark of no prose."""
    k = (F.col("doc_id") + F.col("line")) % 4
    w = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", _first_word().alias("ours")).where("ours <> ''")
    version = F.when(k == 0, F.replace("ours", F.lit("h"), F.lit("b"))).when(k == 1, F.replace("ours", F.lit("o"), F.lit("oó"))).when(k == 2, F.concat("ours", F.lit("~"))).otherwise(F.replace("ours", F.lit("a"), F.lit("e")))
    v = w.withColumn("version", version)
    return v.select("doc_id", "line", R.b_for_h("ours", "version").alias("b_for_h"), R.brings(R.half_accented, "ours", "version").alias("half_accented"), R.brings(R.unprinted, "ours", "version").alias("unprinted"))


@query(
    f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, regexp_extract(text, '[a-z]{{3,}}') AS ours FROM lines)
    SELECT doc_id, line, true AS misread FROM w WHERE ours <> ''"""
)
def ij_misreadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed ij in the middle of a word, read in five ways, is found as a misreading in each."""
    w = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", _first_word().alias("w")).where("w <> ''")
    read = F.element_at(F.array(*map(F.lit, R.IJ_READ)), ((F.col("doc_id") + F.col("line")) % 5 + 1).cast("int"))
    around = lambda middle: F.concat(F.substring("w", 1, 2), middle, F.expr("substring(w, 3)"))
    return w.select("doc_id", "line", R.ij_misread(around(F.lit("ij")), around(read)).alias("misread"))


@query(
    f"""WITH {LINES_SQL}, found AS (SELECT source, unnest(regexp_extract_all(replace(text, ', ', '. '), '[\\p{{L}}\\p{{N}}_]+\\.\\s+["''‘’“”(]*\\p{{Ll}}')) AS x FROM lines)
    SELECT source, lower(regexp_extract(x, '^[\\p{{L}}\\p{{N}}_]+')) AS word, count(*) AS n FROM found GROUP BY ALL"""
)
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a book prints with a stop before a lower-case word (here: where its commas stand)."""
    read = lines(table(spark, sf_dir, "documents")).select("source", F.replace("text", F.lit(", "), F.lit(". ")).alias("text"))
    found = read.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)\.\s+[\"'‘’“”(]*\p{Ll}"), 1)).alias("w"))
    return found.groupBy("source", F.lower("w").alias("word")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {LINES_SQL}, n AS (SELECT doc_id, line, regexp_replace(text, '[.!?,]+$', '') AS bare, lead(lower(text)) OVER (PARTITION BY doc_id ORDER BY line) AS following FROM lines)
    SELECT doc_id, line, regexp_matches(bare, '[\\p{{L}}\\p{{N}}’''"”]$') AND regexp_matches(coalesce(following, ''), '^\\s*["''‘’“”(—–-]*\\s*\\p{{Ll}}') AS never FROM n WHERE bare <> ''"""
)
def line_end_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that ends a line on a stop, for its comma, where the next line goes on in lower case."""
    w = Window.partitionBy("doc_id").orderBy("line")
    n = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", F.regexp_replace("text", "[.!?,]+$", "").alias("bare"), F.lead(F.lower("text")).over(w).alias("following")).where("bare <> ''")
    never = R.stop_for_comma(F.when(F.col("line") % 2 == 0, F.concat("bare", F.lit(","))).otherwise(F.col("bare")), F.concat("bare", F.lit(".")), "following")
    return n.select("doc_id", "line", F.when(F.col("bare").rlike(r"[\p{L}\p{N}’'\"”]$"), never).otherwise(False).alias("never"))


@query(
    f"""WITH {LINES_SQL}, a AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line) AS above FROM lines)
    SELECT doc_id, line, above IS NULL OR trim(above) = '' OR regexp_matches(above, '[.!?…:;’”''")\\]]\\s*$') OR NOT regexp_matches(text, '^\\s*\\p{{Ll}}') AS opens,
      (doc_id + line) % 7 = 0 OR regexp_matches(text, '^\\s*([*·•⁂~#◊♦]\\s*){{3,}}$') AS breaks FROM a"""
)
def paragraph_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can open a paragraph, and lines of ornaments (put for every seventh line) that part scenes."""
    w = Window.partitionBy("doc_id").orderBy("line")
    a = lines(table(spark, sf_dir, "documents")).withColumn("above", F.lag("text").over(w))
    shown = F.when((F.col("doc_id") + F.col("line")) % 7 == 0, F.when(F.col("line") % 2 == 0, "* * *").otherwise("⁂")).otherwise(F.col("text"))
    return a.select("doc_id", "line", R.starts_paragraph("above", "text").alias("opens"), R.scene_break(shown).alias("breaks"))


@query(
    """SELECT doc_id, md5(text) AS tidied, md5(translate(lower(text), 'l1|', 'iii')) AS strokes,
      md5(replace(text, 'e', 'zh')) AS latin FROM documents"""
)
def spelled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures, blanks before punctuation, Cyrillic letters and letters of one stroke are put into a text and folded away again."""
    read = F.replace(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit(", "), F.lit(" , ")), F.lit(". "), F.lit(" . "))
    cyrillic = F.replace(F.replace("text", F.lit("a"), F.lit("а")), F.lit("e"), F.lit("ж"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.tidied(read)).alias("tidied"), F.md5(R.strokes("text")).alias("strokes"), F.md5(R.latin(cyrillic)).alias("latin"))


@query(
    """SELECT event_id, 'PDF page ' || event_id || ' (the page prints ' || CASE WHEN event_id - 12 >= 1 THEN CAST(event_id - 12 AS VARCHAR) ELSE 'no number' END || ')' AS label,
      CASE WHEN event_id % 20000 < 60 THEN 'under a minute' WHEN event_id % 20000 // 60 < 60 THEN (event_id % 20000 // 60) || ' min'
        ELSE (event_id % 20000 // 3600) || ' h ' || lpad(CAST(event_id % 20000 // 60 % 60 AS VARCHAR), 2, '0') || ' min' END AS took FROM events"""
)
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by both their numbers, and spans of time in words."""
    e = table(spark, sf_dir, "events").select("event_id", F.lit(12).alias("offset"))
    whole = F.col("event_id") % 20000 - F.col("event_id") % 20000 % 60
    return e.select("event_id", R.page_label("event_id", "offset").alias("label"), R.duration(whole).alias("took"))


@query(
    f"""WITH tops AS (SELECT doc_id, source, (1 + n_chars % 40) / 100.0 AS top FROM documents), usual AS (SELECT source, median(top) AS m FROM tops GROUP BY source)
    SELECT doc_id, source, top > m + {SUNK} AS sunk FROM tops JOIN usual USING (source)"""
)
def sunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that start well below the usual height of their book."""
    tops = table(spark, sf_dir, "documents").select("doc_id", "source", ((1 + F.col("n_chars") % 40) / 100.0).alias("top"))
    # one row for each book: a broadcast where Spark finds it small, else a shuffle
    usual = tops.groupBy("source").agg(F.median("top").alias("m"))
    return tops.join(usual, "source").select("doc_id", "source", (F.col("top") > F.col("m") + SUNK).alias("sunk"))


@query(
    """WITH s AS (SELECT source, count(*) FILTER (l.quality = 1 AND d.n_chars > 1000) AS hit, count(*) FILTER (d.n_chars > 1000) AS found, count(*) FILTER (l.quality = 1) AS true_ones
      FROM documents d JOIN labels l USING (doc_id) GROUP BY source), r AS (SELECT source, coalesce(hit / nullif(found, 0), 0) AS p, coalesce(hit / nullif(true_ones, 0), 0) AS q FROM s)
    SELECT source, round(p, 6) AS precision_share, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r"""
)
def scores_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of long documents as good ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 1000).alias("found"))
    s = d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("true_one")), "doc_id").groupBy("source")
    s = s.agg(F.count_if(F.col("true_one") & F.col("found")).alias("hit"), F.count_if("found").alias("n"), F.count_if("true_one").alias("m"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    r = s.select("source", share(F.col("hit"), F.col("n")).alias("p"), share(F.col("hit"), F.col("m")).alias("q"))
    return r.select("source", F.round("p", 6).alias("precision_share"), F.round("q", 6).alias("recall"), F.round(R.f1("p", "q"), 6).alias("f1"))


@query(
    """WITH latest AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey), picked AS (SELECT o_custkey, d, max(o_orderkey) AS o_orderkey FROM latest JOIN orders USING (o_custkey) WHERE o_orderdate = d GROUP BY ALL)
    SELECT o_custkey, o_orderkey FROM picked WHERE (o_custkey % 7, o_custkey % 3) IN ((0, 0), (2, 1), (5, 2))"""
)
def latest_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest dated build of each book, of the listed (book, kind) pairs only."""
    only = spark.createDataFrame([(0, 0), (2, 1), (5, 2)], "a long, b long")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return o.join(only, (F.col("o_custkey") % 7 == F.col("a")) & (F.col("o_custkey") % 3 == F.col("b")), "left_semi").select("o_custkey", F.col("last.o_orderkey").alias("o_orderkey"))
