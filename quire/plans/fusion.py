"""Several readers of one line: suspects, votes, priors, an arbiter, a budget of questions."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import change_kind, smoothed
from ..operators.storage import cut
from ..registry import query
from ..sources.tables import READERS, READINGS_SQL, capitals, lines, readings, table

MIN_BOOKS = 2
#: Characters that count as quotation marks, and accents taken off, for DuckDB.
NO_QUOTES = "'\"‘’“”‚„«»`´"
PLAIN_SQL = "translate({0}, 'áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ', 'aaaaaeeeeiiiiooooouuuuncAAAAEEEEIIIIOOOOUUUUNC')"
KIND_SQL = f"""CASE WHEN {PLAIN_SQL.format("text")} = {PLAIN_SQL.format("reading")} THEN 'accent' WHEN replace(text, ' ', '') = replace(reading, ' ', '') THEN 'space'
  WHEN lower(text) = lower(reading) THEN 'case' WHEN regexp_replace(text, '[''"‘’“”‚„«»`´]', '', 'g') = regexp_replace(reading, '[''"‘’“”‚„«»`´]', '', 'g') THEN 'quote' ELSE 'letters' END"""


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(lines(table(spark, sf_dir, "documents")))


def read_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, a page's in one task: its text is sent once, not each reading of its lines, and what is grouped by
    page and line is grouped where it lies, a partition of texts at a time."""
    return readings(lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").repartition("doc_id")))


@query(
    f"""WITH {READINGS_SQL}, v AS (SELECT doc_id, line, reading, count(*) AS votes, string_agg(reader, ',' ORDER BY reader) AS readers FROM readings GROUP BY doc_id, line, reading),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY votes DESC, readers) AS nth, count(*) OVER (PARTITION BY doc_id, line) AS versions FROM v)
    SELECT doc_id, line, reading AS chosen, votes, readers, versions FROM r WHERE nth = 1 AND versions > 1"""
)
def suspect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which readers differ, with the version most of them read."""
    # each reader's votes are a number: no list is kept, and names are put together in order of the alphabet
    each = [F.count_if(F.col("reader") == r).cast("int").alias(r) for r in sorted(READERS)]
    names = F.array_join(F.flatten(F.array(*[F.array_repeat(F.lit(r), F.col(r)) for r in sorted(READERS)])), ",")
    v = read_by_page(spark, sf_dir).groupBy("doc_id", "line", "reading").agg(F.count("*").alias("votes"), *each).select("doc_id", "line", "reading", "votes", names.alias("readers"))
    best = F.min_by(F.struct("reading", "votes", "readers"), F.struct(-F.col("votes"), "readers"))
    g = v.groupBy("doc_id", "line").agg(best.alias("b"), F.count("*").alias("versions")).where("versions > 1")
    return g.select("doc_id", "line", F.col("b.reading").alias("chosen"), F.col("b.votes").alias("votes"), F.col("b.readers").alias("readers"), "versions")


@query(
    f"""WITH {READINGS_SQL}, k AS (SELECT source, reader, {KIND_SQL} AS kind, reading = translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS right_one FROM readings WHERE reading <> text)
    SELECT reader, kind, count(*) AS seen, CAST(sum(CASE WHEN right_one THEN 1 ELSE 0 END) AS BIGINT) AS "right", round((sum(CASE WHEN right_one THEN 1 ELSE 0 END) + 1) / (count(*) + 2), 6) AS prior
    FROM k GROUP BY reader, kind HAVING count(DISTINCT source) >= 2"""
)
def substitution_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a kind of change by a reader was the print, kinds of fewer than two books left out."""
    k = read(spark, sf_dir).where("reading <> text").select("source", "reader", change_kind("text", "reading").alias("kind"), (F.col("reading") == capitals("text")).alias("ok"))
    by = k.groupBy("reader", "kind", "source").agg(F.count("*").alias("n"), F.count_if("ok").alias("r"))
    out = by.groupBy("reader", "kind").agg(F.sum("n").alias("seen"), F.sum("r").alias("right"), F.count("*").alias("books")).where(F.col("books") >= MIN_BOOKS)
    return out.select("reader", "kind", "seen", "right", F.round(smoothed("right", "seen"), 6).alias("prior"))


@query(
    f"""WITH {READINGS_SQL}, b AS (SELECT source, reader, {KIND_SQL} AS kind, count(*) AS n, sum(CASE WHEN reading = translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') THEN 1 ELSE 0 END) AS r FROM readings WHERE reading <> text GROUP BY 1, 2, 3),
    t AS (SELECT reader, kind, sum(n) AS n, sum(r) AS r, count(*) AS books FROM b GROUP BY reader, kind)
    SELECT b.source, b.reader, b.kind, CAST(t.n - b.n AS BIGINT) AS seen, round(CASE WHEN t.books - 1 >= 2 THEN (t.r - b.r + 1) / (t.n - b.n + 2) ELSE 0.5 END, 6) AS prior FROM b JOIN t USING (reader, kind)"""
)
def priors_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's priors without what it says itself: totals less its own sums, and its own mark in the count of books."""
    k = read(spark, sf_dir).where("reading <> text").select("source", "reader", change_kind("text", "reading").alias("kind"), (F.col("reading") == capitals("text")).alias("ok"))
    b = k.groupBy("source", "reader", "kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("r"))
    w = Window.partitionBy("reader", "kind")
    t = b.withColumn("tn", F.sum("n").over(w)).withColumn("tr", F.sum("r").over(w)).withColumn("books", F.count("*").over(w))
    prior = F.when(F.col("books") - 1 >= MIN_BOOKS, (F.col("tr") - F.col("r") + 1) / (F.col("tn") - F.col("n") + 2)).otherwise(F.lit(0.5))
    return t.select("source", "reader", "kind", (F.col("tn") - F.col("n")).alias("seen"), F.round(prior, 6).alias("prior"))


def budgeted(suspects: DataFrame, by: list[str], budget, below: float) -> DataFrame:
    """``asked`` for the least sure of each group: the budget is dealt first and those sure enough fall away after, their
    places not filled again. Expects unseen, sure, ident."""
    w = Window.partitionBy(*by).orderBy(F.col("unseen").desc(), "sure", "ident")
    return suspects.withColumn("nth", F.row_number().over(w)).withColumn("asked", (F.col("nth") <= budget) & (F.col("unseen") | (F.col("sure") < below)))


@query(
    f"""WITH {READINGS_SQL}, s AS (SELECT source, doc_id, line, count(*) FILTER (WHERE reading <> text) AS n, bool_and(reading = '') AS unseen,
      (('0x' || substr(md5(concat_ws(':', doc_id, line)), 1, 4))::BIGINT) / 65536.0 AS sure FROM readings GROUP BY source, doc_id, line HAVING count(*) FILTER (WHERE reading <> text) > 0),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source),
    r AS (SELECT s.*, pages, row_number() OVER (PARTITION BY s.source ORDER BY unseen DESC, sure, doc_id, line) AS nth FROM s JOIN p USING (source))
    SELECT source, doc_id, line FROM r WHERE nth <= pages AND (unseen OR sure < 0.02)"""
)
def question_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a page: the least sure lines of each book."""
    rows = read(spark, sf_dir)
    sure = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "line")), 1, 4), 16, 10).cast("double") / 65536
    s = rows.groupBy("source", "doc_id", "line").agg(F.count_if(F.col("reading") != F.col("text")).alias("n"), F.every(F.col("reading") == "").alias("unseen")).where("n > 0")
    s = s.withColumn("sure", sure).withColumn("ident", F.struct("doc_id", "line"))
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    return budgeted(s.join(pages, "source"), ["source"], F.col("pages"), 0.02).where("asked").select("source", "doc_id", "line")


@query(
    f"""WITH {READINGS_SQL}, f AS (SELECT doc_id, line, reader, reading, row_number() OVER (PARTITION BY doc_id, line, regexp_replace(lower(reading), '[^a-z]', '', 'g') ORDER BY reader) AS nth FROM readings WHERE reading <> '')
    SELECT doc_id, line, reader, reading FROM f WHERE nth = 1"""
)
def version_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct versions of a line under a fold; the first reader's spelling of each stays."""
    fold = F.regexp_replace(F.lower("reading"), "[^a-z]", "")
    rows = read_by_page(spark, sf_dir).where("reading <> ''").withColumn("fold", fold)
    first = rows.groupBy("doc_id", "line", "fold").agg(F.min_by(F.struct("reader", "reading"), "reader").alias("v"))
    return first.select("doc_id", "line", "v.reader", "v.reading")


@query(
    r"""WITH w AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), lex AS (SELECT lang AS lex_lang, word FROM w GROUP BY lang, word HAVING count(*) >= 20),
    c AS (SELECT doc_id, lex_lang, count(*) AS known FROM w JOIN lex USING (word) GROUP BY doc_id, lex_lang), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY known DESC, lex_lang) AS nth FROM c)
    SELECT doc_id, lex_lang AS guess, known FROM r WHERE nth = 1"""
)
def language_by_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language whose word list covers most of a page. Word lists are counted and written first: what Spark finds small enough
    goes to the pages, so no page's words are shuffled; else pages and lists meet by word. A page's counts are all that is left to send."""
    w = table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word"))
    lex = cut(w.groupBy(F.col("lang").alias("lex_lang"), "word").agg(F.count("*").alias("n")).where("n >= 20").drop("n"), "lexicon")
    known = w.drop("lang").join(lex, "word").groupBy("doc_id", "lex_lang").agg(F.count("*").alias("known"))
    best = known.groupBy("doc_id").agg(F.min_by(F.struct("lex_lang", "known"), F.struct(-F.col("known"), F.col("lex_lang").isNull(), "lex_lang")).alias("b"))
    return best.select("doc_id", F.col("b.lex_lang").alias("guess"), F.col("b.known").alias("known"))


def features(rows: DataFrame) -> DataFrame:
    """Features of each version of a line, for the arbiter. Characters and words are counted where they stand: no text is made anew."""
    n = F.length("reading")
    count = lambda p: F.regexp_count("reading", F.lit(p)).cast("double")
    of = lambda ch: (n - F.length(F.replace("reading", F.lit(ch), F.lit("")))).cast("double")
    return rows.select(
        "source", "doc_id", "line", "reader", (F.col("reading") == F.col("text")).cast("double").alias("label"),
        n.cast("double").alias("f_length"), count(r"\S+").alias("f_words"), F.try_divide(count("[A-Z]"), n).alias("f_upper"), of(",").alias("f_commas"), of(".").alias("f_stops"),
        of("e").alias("f_e"), F.when(n > 0, (n - count("[ \u0300-\u036f]")) / n).otherwise(0.0).alias("f_dense"),
    ).na.fill(0.0)


@query()
def arbiter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over versions, trained on other books, normalised within a line and calibrated by logistic regression on log-odds.
    Books are dealt into three folds, and each is scored by a model that the second has trained and the third calibrated. Features are
    written once, not made again for each pass of the training, and equal versions are one training row with their number as its weight."""
    rows = features(read(spark, sf_dir))
    names = [x for x in rows.columns if x.startswith("f_")]
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("source"), F.lit(3))).drop("source"), "versions")
    alike = cut(rows.groupBy("fold", "label", *names).agg(F.count("*").cast("double").alias("n")), "alike")
    ready = VectorAssembler(inputCols=names, outputCol="features").transform
    p = vector_to_array("probability")[1]
    odds = F.log(F.greatest(F.col("p"), F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6)))
    w = Window.partitionBy("doc_id", "line")
    out = None
    for k in range(3):
        model = GBTClassifier(maxDepth=3, maxIter=8, seed=1, weightCol="n").fit(ready(alike.where(F.col("fold") == (k + 1) % 3)))
        held = model.transform(ready(alike.where(F.col("fold") == (k + 2) % 3))).withColumn("p", p).groupBy("p", "label").agg(F.sum("n").alias("n"))
        curve = LogisticRegression(featuresCol="odds_v", weightCol="n").fit(VectorAssembler(inputCols=["odds"], outputCol="odds_v").transform(held.withColumn("odds", odds)))
        calibrated = 1 / (1 + F.exp(-(float(curve.coefficients[0]) * odds + float(curve.intercept))))
        scored = model.transform(ready(rows.where(F.col("fold") == k))).withColumn("p", p)
        scored = scored.select("doc_id", "line", "reader", "label", calibrated.alias("chance"), (F.col("p") / F.greatest(F.sum("p").over(w), F.lit(1e-9))).alias("share"))
        out = scored if out is None else out.union(scored)
    return out


@query()
def odd_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors further from the mean of their label than two deviations of that distance: pictures unlike their kind."""
    v = table(spark, sf_dir, "embeddings")
    flat = v.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    mean = flat.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    d = flat.join(mean, ["label", "dim"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d"))
    usual = d.groupBy("label").agg(F.avg("d").alias("mean"), F.stddev("d").alias("spread"))
    return d.join(usual, "label").where("d > mean + 2 * spread").select("vec_id", "label", "d")
