"""Boxes and lines, page kinds, overlays of answers, settings and words compared, ranked flags, three-valued verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bare_words, smoothed, words
from ..operators.storage import cut
from ..registry import query
from ..sources.tables import LINES_SQL, READINGS_SQL, lines, readings, table

#: Events as marks on a page (a user): lines are points, sign-ups are boxes around them.
BOXES_SQL = """pts AS (SELECT user_id AS page, event_id AS line, value AS x, event_id % 97 AS y FROM events WHERE event_type = 'view'),
  box AS (SELECT user_id AS page, event_id AS region, value - 3 AS x0, value + 3 AS x1, event_id % 97 - 12 AS y0, event_id % 97 + 12 AS y1, event_id % 11 AS conf FROM events WHERE event_type = 'signup')"""


def points_and_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("y", F.col("event_id") % 97)
    pts = e.where("event_type = 'view'").select(F.col("user_id").alias("page"), F.col("event_id").alias("line"), F.col("value").alias("x"), "y")
    v, y = F.col("value"), F.col("y")
    box = e.where("event_type = 'signup'").select(F.col("user_id").alias("page"), F.col("event_id").alias("region"), (v - 3).alias("x0"), (v + 3).alias("x1"), (y - 12).alias("y0"), (y + 12).alias("y1"), (F.col("event_id") % 11).alias("conf"))
    return pts, box


def inside(pts: DataFrame, box: DataFrame) -> DataFrame:
    """Points with the boxes that hold them; pages are the equi-key, so only a page's own boxes are tried."""
    b = box.withColumnRenamed("page", "_page")
    return pts.join(b, (F.col("page") == F.col("_page")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).drop("_page")


@query(f"WITH {BOXES_SQL} SELECT p.line, arg_max(b.region, (conf, -region)) AS region, count(*) AS n FROM pts p JOIN box b ON p.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY p.line")
def surest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line the surest region that holds it."""
    return inside(*points_and_boxes(spark, sf_dir)).groupBy("line").agg(F.max_by("region", F.struct("conf", -F.col("region"))).alias("region"), F.count("*").alias("n"))


@query(f"WITH {BOXES_SQL} SELECT region FROM box b WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
def missing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions without any line: text that a layer lacks."""
    pts, box = points_and_boxes(spark, sf_dir)
    return box.join(inside(pts, box).select("region").distinct(), "region", "left_anti").select("region")


@query(
    f"""WITH {BOXES_SQL} SELECT a.region, b.region AS other FROM box a JOIN box b ON a.page = b.page AND a.region < b.region
    WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.5 * 6 * 24"""
)
def covered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of regions of a page of which one covers half of the other."""
    _, box = points_and_boxes(spark, sf_dir)
    a, b = box.alias("a"), box.alias("b")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}"))
    pairs = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.region") < F.col("b.region")))
    return pairs.where(overlap("x0", "x1") * overlap("y0", "y1") >= 0.5 * 6 * 24).select(F.col("a.region").alias("region"), F.col("b.region").alias("other"))


@query(
    """WITH o AS (SELECT user_id AS book, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS "offset" FROM events WHERE event_type = 'click'),
    c AS (SELECT book, "offset", count(*) AS n FROM o GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY book) AS total, row_number() OVER (PARTITION BY book ORDER BY n DESC, "offset") AS r FROM c)
    SELECT book, "offset", n FROM t WHERE r = 1 AND n >= 3 AND n >= 0.25 * total"""
)
def page_offset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest offset of a book, if three pages and a quarter of them have it."""
    o = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("book"), (F.get_json_object("props", "$.k").cast("long") % 7).alias("offset"))
    c = o.groupBy("book", "offset").agg(F.count("*").alias("n"))
    best = c.groupBy("book").agg(F.max_by(F.struct("offset", "n"), F.struct("n", -F.col("offset"))).alias("b"), F.sum("n").alias("total"))
    return best.where("b.n >= 3 AND b.n >= 0.25 * total").select("book", "b.offset", "b.n")


CLUES_SQL = f"""{LINES_SQL}, c AS (SELECT doc_id, count(*) AS n_lines, sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS n_words, median(length(text)) AS mid,
  avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END) AS numbered, max(CASE WHEN regexp_matches(text, 'License') THEN 1 ELSE 0 END) AS imprint FROM lines GROUP BY doc_id)"""


@query(
    f"""WITH {CLUES_SQL} SELECT doc_id, n_lines, CAST(n_words AS BIGINT) AS n_words, CASE WHEN imprint = 1 THEN 'colophon' WHEN n_words < 5 THEN 'blank' WHEN numbered > 0.4 THEN 'contents' WHEN n_lines <= 3 AND n_words < 40 THEN 'title'
    WHEN mid < 40 THEN 'verse' ELSE 'body' END AS kind FROM c"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clues of each page, then the first kind that fits them."""
    t = lines(table(spark, sf_dir, "documents"))
    c = t.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.size(words("text"))).alias("n_words"), F.median(F.length("text")).alias("mid"), F.avg(F.col("text").rlike("[0-9]").cast("double")).alias("numbered"), F.max(F.col("text").contains("License")).alias("imprint")
    )
    kind = F.when(F.col("imprint"), "colophon").when(F.col("n_words") < 5, "blank").when(F.col("numbered") > 0.4, "contents").when((F.col("n_lines") <= 3) & (F.col("n_words") < 40), "title").when(F.col("mid") < 40, "verse").otherwise("body")
    return c.select("doc_id", "n_lines", "n_words", kind.alias("kind"))


@query(
    f"""WITH {LINES_SQL}, k AS (SELECT source, doc_id, line, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key FROM lines WHERE length(text) BETWEEN 1 AND 60),
    f AS (SELECT source, key, min(doc_id) AS first_doc FROM k WHERE key <> '' GROUP BY source, key) SELECT doc_id, line FROM k JOIN f USING (source, key) WHERE doc_id > first_doc"""
)
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines whose key stood on an earlier page of the book; a page's own do not count against each other."""
    k = lines(table(spark, sf_dir, "documents")).where(F.length("text").between(1, 60)).withColumn("key", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")).where("key <> ''")
    first = k.groupBy("source", "key").agg(F.min("doc_id").alias("first_doc"))
    return k.join(first, ["source", "key"]).where("doc_id > first_doc").select("doc_id", "line")


@query(
    f"""WITH {LINES_SQL}, s AS (SELECT *, lag(text) OVER w AS prev, lead(text) OVER w AS nxt FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, line, coalesce(regexp_matches(prev, '[.!?]$'), true) AS opens, coalesce(regexp_matches(nxt, '^[a-z]'), false) AS runs_on FROM s WHERE regexp_matches(text, '[,;]$|[a-z]$')"""
)
def sentences_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line")
    s = lines(table(spark, sf_dir, "documents")).withColumn("prev", F.lag("text").over(w)).withColumn("nxt", F.lead("text").over(w)).where(F.col("text").rlike("[,;]$|[a-z]$"))
    return s.select("doc_id", "line", F.coalesce(F.col("prev").rlike("[.!?]$"), F.lit(True)).alias("opens"), F.coalesce(F.col("nxt").rlike("^[a-z]"), F.lit(False)).alias("runs_on"))


@query(
    """WITH a AS (SELECT 'u' || (user_id % 40) AS k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS v FROM events WHERE event_type = 'view' AND user_id % 3 > 0 GROUP BY 1),
    b AS (SELECT 'u' || (user_id % 50) AS k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS setting, a.v AS was, b.v AS now FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v"""
)
def settings_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric difference of two runs' settings."""
    e = table(spark, sf_dir, "events").withColumn("v", F.get_json_object("props", "$.k").cast("long"))
    side = lambda d, mod, name: d.groupBy(F.concat(F.lit("u"), F.col("user_id") % mod).alias("setting")).agg(F.max("v").alias(name))
    both = side(e.where("event_type = 'view' AND user_id % 3 > 0"), 40, "was").join(side(e.where("event_type = 'click'"), 50, "now"), "setting", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


@query(
    f"""WITH {READINGS_SQL}, w AS (SELECT doc_id, line, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS a, regexp_extract_all(lower(reading), '[\\p{{L}}\\p{{N}}_]+') AS b FROM readings WHERE reader = 'glm' AND reading <> text)
    SELECT doc_id, line, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS lost, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') AS gained FROM w"""
)
def words_lost_and_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(lines(table(spark, sf_dir, "documents"))).where("reader = 'glm' AND reading <> text").select("doc_id", "line", bare_words("text").alias("a"), bare_words("reading").alias("b"))
    diff = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return r.select("doc_id", "line", diff("a", "b").alias("lost"), diff("b", "a").alias("gained"))


@query(
    r"""WITH w AS (SELECT lang, source, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), lex AS (SELECT word, count(DISTINCT source) AS books FROM w GROUP BY word),
    v AS (SELECT doc_id, CASE WHEN books >= 5 THEN true WHEN books >= 2 THEN NULL ELSE false END AS known FROM w JOIN lex USING (word))
    SELECT doc_id, count(*) FILTER (WHERE known) AS n_known, count(*) FILTER (WHERE NOT known) AS n_strange, count(*) FILTER (WHERE known IS NULL) AS n_unsure, CASE WHEN bool_or(NOT known) THEN false WHEN bool_or(known IS NULL) THEN NULL ELSE true END AS verdict FROM v GROUP BY doc_id"""
)
def lexicon_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued: a word of five books is known, of one book strange, between them unsure; a page with a strange word is
    not vouched for, one with an unsure word is left open."""
    w = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(bare_words("text")).alias("word"))
    # written first, and without the words of one book: what is not in the list is strange. Small enough a list goes to the pages
    books = w.where("source IS NOT NULL").select("word", "source").distinct().groupBy("word").agg(F.count("*").alias("books"))
    lex = cut(books.where("books >= 2").select("word", (F.col("books") >= 5).alias("known")), "books")
    v = w.select("doc_id", "word").join(lex, "word", "left")
    n = F.count_if
    g = v.groupBy("doc_id").agg(n(F.col("known")).alias("n_known"), n(F.col("known").isNull()).alias("n_strange"), n(~F.col("known")).alias("n_unsure"))
    return g.withColumn("verdict", F.when(F.col("n_strange") > 0, False).when(F.col("n_unsure") > 0, F.lit(None)).otherwise(True))


@query(
    f"""WITH {READINGS_SQL}, f AS (SELECT source, doc_id, line, reader AS reason, reading = '' AS hit FROM readings WHERE reading <> text), b AS (SELECT source, reason, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM f GROUP BY ALL),
    t AS (SELECT reason, sum(n) AS n, sum(h) AS h FROM b GROUP BY reason), s AS (SELECT b.source, b.reason, (t.h - b.h + 1) / (t.n - b.n + 2) AS score FROM b JOIN t USING (reason)),
    r AS (SELECT f.source, doc_id, line, f.reason, row_number() OVER (PARTITION BY f.source ORDER BY score DESC, md5(concat_ws(':', doc_id, line, f.reason))) AS rank FROM f JOIN s ON f.source = s.source AND f.reason = s.reason)
    SELECT source, rank, doc_id, line, reason FROM r WHERE rank <= 10"""
)
def ranked_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten flags of each book whose reason caught errors most often in other books, in a fixed shuffle within a reason."""
    f = readings(lines(table(spark, sf_dir, "documents"))).where("reading <> text").select("source", "doc_id", "line", F.col("reader").alias("reason"), (F.col("reading") == "").alias("hit"))
    w = Window.partitionBy("reason")
    b = f.groupBy("source", "reason").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    s = b.select("source", "reason", smoothed(F.sum("h").over(w) - F.col("h"), F.sum("n").over(w) - F.col("n")).alias("score"))
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.md5(F.concat_ws(":", "doc_id", "line", "reason")))
    ranked = f.join(s, ["source", "reason"]).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where("rank <= 10").select("source", "rank", "doc_id", "line", "reason")


@query(
    f"""WITH {LINES_SQL}, old AS (SELECT doc_id, line, text FROM lines WHERE text <> '' AND line < 20), ans AS (SELECT doc_id, line + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS line, text FROM old WHERE doc_id % 5 = 0 AND line % 4 = 1),
    here AS (SELECT a.doc_id, a.line, a.text, o.line AS at FROM ans a JOIN old o ON a.doc_id = o.doc_id AND a.text = o.text)
    SELECT a.doc_id, a.line, arg_min(h.at, (abs(h.at - a.line), h.at)) AS placed FROM ans a LEFT JOIN here h ON a.doc_id = h.doc_id AND a.line = h.line AND a.text = h.text GROUP BY a.doc_id, a.line"""
)
def relocated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers find their line again by its text, the nearest of several."""
    old = lines(table(spark, sf_dir, "documents")).where("text <> '' AND line < 20").select("doc_id", "line", "text")
    ans = old.where("doc_id % 5 = 0 AND line % 4 = 1").withColumn("line", F.col("line") + (F.col("doc_id") % 3 == 0).cast("long"))
    met = ans.join(old.withColumnRenamed("line", "at"), ["doc_id", "text"], "left")
    return met.groupBy("doc_id", "line").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("line")), "at")).alias("placed"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND (user_id, CAST(json_extract_string(props, '$.k') AS BIGINT)) NOT IN (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'purchase')")
def uncached_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run has still to do: items whose key is not in the cache."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.where("event_type = 'view'").join(e.where("event_type = 'purchase'").select("user_id", "k"), ["user_id", "k"], "left_anti").select("event_id", "user_id")


@query(
    f"""WITH {LINES_SQL}, n AS (SELECT doc_id, line, CAST(regexp_extract(text, '([0-9]+)', 1) AS VARCHAR) AS mark FROM lines WHERE regexp_matches(text, '[0-9]')), p AS (SELECT doc_id, max(line) AS last_line FROM lines GROUP BY doc_id)
    SELECT n.doc_id, n.line, mark, coalesce((SELECT min(m.line) FROM n m WHERE m.doc_id = n.doc_id AND m.mark = n.mark AND m.line < n.line), last_line) AS linked FROM n JOIN p USING (doc_id)"""
)
def notes_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to the first line above that holds their mark; else to the page's last."""
    t = lines(table(spark, sf_dir, "documents"))
    last = t.groupBy("doc_id").agg(F.max("line").alias("last_line"))
    n = t.where(F.col("text").rlike("[0-9]")).select("doc_id", "line", F.regexp_extract("text", "([0-9]+)", 1).alias("mark"))
    first = n.withColumn("first", F.min("line").over(Window.partitionBy("doc_id", "mark")))
    found = F.when(F.col("first") < F.col("line"), F.col("first"))
    return first.join(last, "doc_id").select("doc_id", "line", "mark", F.coalesce(found, "last_line").alias("linked"))


@query(
    f"""WITH {LINES_SQL}, e AS (SELECT item_id, substr(text, 1, 24) AS printed FROM benchmark WHERE length(text) >= 24), c AS (SELECT e.item_id, l.doc_id, l.line, (length(l.text) - length(replace(l.text, e.printed, ''))) // 24 AS times FROM e JOIN lines l ON contains(l.text, e.printed))
    SELECT item_id, doc_id, line, times = 1 AS applies FROM c"""
)
def errata_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a misprint's words stand; they must occur once. The words' first token is the equi-key that finds their lines."""
    token = lambda c: F.substring_index(c, " ", 1)
    e = table(spark, sf_dir, "benchmark").where("length(text) >= 24").select("item_id", F.substring("text", 1, 24).alias("printed"))
    e = e.withColumn("t", token(F.col("printed")))
    t = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", "text")
    tails = t.select("doc_id", "line", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    # a line's word may end in the token that begins the misprint
    met = tails.join(e, F.col("word") == F.col("t")).where(F.col("text").contains(F.col("printed"))).select("item_id", "doc_id", "line", "text", "printed").distinct()
    times = (F.length("text") - F.length(F.replace("text", F.col("printed"), F.lit("")))) / 24
    return met.select("item_id", "doc_id", "line", (times == 1).alias("applies"))


@query(
    """WITH s AS (SELECT doc_id, unnest(string_split(concat_ws('. ', text, CASE WHEN doc_id % 7 = 0 THEN text || '. ' || text END), '. ')) AS sentence FROM documents), c AS (SELECT doc_id, sentence, count(*) AS n FROM s WHERE len(string_split(sentence, ' ')) >= 4 GROUP BY ALL HAVING count(*) >= 3)
    SELECT doc_id, count(*) AS sentences, max(n) AS most FROM c GROUP BY doc_id"""
)
def repeating_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in which a sentence of four words or more comes three times: a model that repeats itself."""
    looped = F.concat_ws(". ", "text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(". "), "text")))  # some pages come three times
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(looped, r"\. ")).alias("sentence")).where(F.size(F.split("sentence", " ")) >= 4)
    c = s.groupBy("doc_id", F.xxhash64("sentence").alias("key")).agg(F.count("*").alias("n")).where("n >= 3")
    return c.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max("n").alias("most"))


@query(
    """WITH o AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '^[A-Z]')) AS capital FROM documents GROUP BY lang, source)
    SELECT lang, source, n, capital, n >= 5 AND capital >= 0.8 * n AS habit FROM o"""
)
def opening_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a book open its pages with a capital, by share and support."""
    o = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("^[A-Z]")).alias("capital"))
    return o.withColumn("habit", (F.col("n") >= 5) & (F.col("capital") >= 0.8 * F.col("n")))


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]*[aeiou][a-z]*')) AS word FROM documents WHERE lang = 'fr'), p AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM w)
    SELECT word, i AS at, substr(word, 1, i - 1) || translate(substr(word, i, 1), 'aeiou', 'áéíóú') || substr(word, i + 1) AS variant FROM p WHERE contains('aeiou', substr(word, i, 1))"""
)
def accent_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the stress put on one of its vowels."""
    w = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]*[aeiou][a-z]*"), 0)).alias("word")).distinct()
    p = w.select("word", F.explode(F.sequence(F.lit(1).cast("long"), F.length("word").cast("long"))).alias("at"))
    p = p.where(F.expr("contains('aeiou', substring(word, int(at), 1))"))
    return p.select("word", "at", F.expr("concat(substring(word, 1, int(at) - 1), translate(substring(word, int(at), 1), 'aeiou', 'áéíóú'), substring(word, int(at) + 1))").alias("variant"))


@query(
    """WITH n AS (SELECT user_id AS book, value, median(value) OVER (PARTITION BY user_id) AS mid, event_id FROM events WHERE event_type = 'view') SELECT event_id, round(value / mid, 4) AS ratio FROM n WHERE value > 3 * mid"""
)
def signal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures over three times the median of their group."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("book"), "value", "event_id")
    mid = e.groupBy("book").agg(F.median("value").alias("mid"))
    return e.join(mid, "book").where("value > 3 * mid").select("event_id", F.round(F.col("value") / F.col("mid"), 4).alias("ratio"))
