"""Ordered records: answers that arrive late, placement, runs, sessions, numbers in sequence; streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import asof, interval_anti, islands, latest, nearest
from ..registry import query
from ..sources.tables import LINES_SQL, lines, table
from ..streaming.events import latest_stream, settle, windowed_stream

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) AS event_id FROM (SELECT * FROM events) GROUP BY user_id, event_type")
def latest_answer_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


@query(
    """WITH h AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id),
    m AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT coalesce(h.user_id, m.user_id) AS user_id, coalesce(h.v, m.v) AS value, CASE WHEN h.v IS NULL THEN 'model' ELSE 'human' END AS origin
    FROM h FULL JOIN m ON h.user_id = m.user_id"""
)
def overlay_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human answers lie over the model's: one pass, the latest of each kind by conditional aggregation."""
    key = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    by = e.groupBy("user_id").agg(*[F.max_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, key)).alias(n) for k, n in (("purchase", "h"), ("view", "m"))])
    return by.select("user_id", F.coalesce("h", "m").alias("value"), F.when(F.col("h").isNull(), "model").otherwise("human").alias("origin"))


@query(
    """SELECT e.event_id, s.event_id AS anchor FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts"""
)
def asof_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("anchor"))
    return asof(left, right, ["user_id"], "ts", ["anchor"]).select("event_id", "anchor")


SPANS_SQL = "SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 600 AS e FROM events WHERE event_type = "


@query(f"SELECT a.event_id FROM ({SPANS_SQL}'click') a WHERE NOT EXISTS (SELECT 1 FROM ({SPANS_SQL}'purchase') h WHERE h.user_id = a.user_id AND a.s < h.e AND h.s < a.e)")
def interval_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed spans that overlap no human one."""
    s = F.expr(f"{MICROS} div 1000000")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", s.alias("s"), (s + 600).alias("e"))
    fixes, human = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'")
    return interval_anti(fixes, human, ["user_id"], "s", "e", "s", "e", 3600).select("event_id")


@query(
    """WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS picture, epoch_us(ts) AS pt FROM events WHERE event_type = 'view')
    SELECT c.event_id, arg_min(picture, (abs(t - pt), pt, picture)) AS picture FROM c LEFT JOIN p USING (user_id) GROUP BY c.event_id"""
)
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.expr(MICROS))
    left = e.where("event_type = 'click'").select("user_id", "t", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("picture"))
    return nearest(left, right, ["user_id"], "t", "picture").select("event_id", "picture")


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    g AS (SELECT *, sum(CASE WHEN prev = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(n) AS first_n, max(n) AS last_n FROM g GROUP BY user_id, run HAVING count(*) > 1"""
)
def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive records that are treated alike."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w).cast("long")).withColumn("prev", F.lag("event_type").over(w))
    runs = islands(e, ["user_id"], ["n"], ~F.col("prev").eqNullSafe(F.col("event_type")), "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.min("n").alias("first_n"), F.max("n").alias("last_n")).where("first_n < last_n")


@query(
    """WITH d AS (SELECT lang, source, doc_id, n_chars, lag(n_chars) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS prev FROM documents),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR n_chars > 1.08 * prev THEN 1 ELSE 0 END) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS island FROM d)
    SELECT lang, source, CAST(island AS BIGINT) AS island, count(*) AS n, min(n_chars) AS smallest, max(n_chars) AS largest FROM g GROUP BY lang, source, island"""
)
def style_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of sizes each within a factor of 1.08 of the one before."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    w = Window.partitionBy("lang", "source").orderBy("n_chars", "doc_id")
    d = d.withColumn("prev", F.lag("n_chars").over(w))
    chained = islands(d, ["lang", "source"], ["n_chars", "doc_id"], F.col("prev").isNull() | (F.col("n_chars") > 1.08 * F.col("prev")))
    return chained.groupBy("lang", "source", "island").agg(F.count("*").alias("n"), F.min("n_chars").alias("smallest"), F.max("n_chars").alias("largest"))


@query(
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line, text, sum(CASE WHEN length(text) BETWEEN 1 AND 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS chapter FROM lines)
    SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_min(text, line) AS heading FROM s GROUP BY doc_id, chapter"""
)
def chapter_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines gathered under the heading (a short line) above them."""
    rows = islands(lines(table(spark, sf_dir, "documents")), ["doc_id"], ["line"], F.length("text").between(1, 40), "chapter")
    return rows.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.min_by("text", "line").alias("heading"))


@query(
    """WITH n AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events WHERE event_type = 'signup'),
    w AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM n)
    SELECT user_id, event_id, CASE WHEN k = prev THEN 'repeated' WHEN k < prev THEN 'back' WHEN k > prev + 1 THEN 'jump' ELSE 'next' END AS finding, k - prev AS step FROM w WHERE prev IS NOT NULL"""
)
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each heading number follows the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    n = n.withColumn("prev", F.lag("k").over(w)).where("prev IS NOT NULL")
    kind = F.when(F.col("k") == F.col("prev"), "repeated").when(F.col("k") < F.col("prev"), "back").when(F.col("k") > F.col("prev") + 1, "jump").otherwise("next")
    return n.select("user_id", "event_id", kind.alias("finding"), (F.col("k") - F.col("prev")).alias("step"))


@query(
    """SELECT conv_id, turn, role, turn - lag(turn) OVER w AS gap, CASE WHEN lag(role) OVER w = role THEN 'same' ELSE 'other' END AS follows, length(text) - lag(length(text)) OVER w AS longer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def conversation_turn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    follows = F.when(F.lag("role").over(w) == F.col("role"), "same").otherwise("other")
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") - F.lag("turn").over(w)).alias("gap"), follows.alias("follows"), (n - F.lag(n).over(w)).alias("longer"))


@query(
    """WITH g AS (SELECT *, sum(CASE WHEN prev = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations))
    SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS turns, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, run"""
)
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("role").over(w))
    runs = islands(c, ["conv_id"], ["turn"], ~F.col("prev").eqNullSafe(F.col("role")), "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), joined.alias("text"))


@query(
    """WITH b AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS p1, lead(text, 1) OVER w AS n1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, concat_ws(' | ', p1, text, n1) AS context FROM b WHERE role = 'assistant'"""
)
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a context judge reads: a line with its neighbours."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("p1", F.lag("text").over(w)).withColumn("n1", F.lead("text").over(w))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.concat_ws(" | ", "p1", "text", "n1").alias("context"))


def settled_numbers(rows: DataFrame, by: str) -> DataFrame:
    """by, n, read, settled: a number that does not follow the last *settled* one by one is kept only if the next one
    follows it; else it is read as the expected. One that follows is the expected either way, so the last number that the
    next one follows (or the first of all) says what is expected from there on: one sort, and no run is carried whole."""
    w = Window.partitionBy(by).orderBy("n", "read")
    at = F.row_number().over(w)
    held = (F.col("_at") == 1) | (F.lead("read").over(w) == F.col("read") + 1)
    start = F.last(F.when(held, F.col("read") - F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(by, "n", "read").withColumn("_at", at).withColumn("settled", start + F.col("_at")).select(by, *[F.col(c).cast("long").alias(c) for c in ("n", "read", "settled")])


@query()
def chapter_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w).cast("long")
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", n.alias("n"), F.when(F.col("event_type") == "click", n + 3).otherwise(n).alias("read"))
    return settled_numbers(rows, "user_id")


@query(
    """SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def stream_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over a stream with a watermark, run to its end."""
    out = settle(windowed_stream(spark, f"{sf_dir}/events.parquet"), "complete")
    return out.select(F.expr(MICROS.replace("ts)", "cast(window.start as timestamp_ntz))")).alias("hour_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each key, kept in state over an append-only stream."""
    return settle(latest_stream(spark, f"{sf_dir}/events.parquet"), "complete").select("user_id", "event_id", "value")
