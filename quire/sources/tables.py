"""Sources: tables as pages, lines and readings; HTML pages; logs of JSON lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = ("layer", "glm", "tess")
BLOCK_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "figcaption"}
#: Pages that a worker takes apart at a time; Spark's batches are up to 10,000 rows or 64 MB.
PAGES = 64
APPARATUS = {"nav", "footer", "header", "script", "style", "aside"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """A document as a page: one row for each of its lines, numbered from 0 in reading order."""
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def capitals(name: str):
    """ASCII letters in upper case: engines differ on the others."""
    return F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def readings(lines: DataFrame, readers: tuple[str, ...] = READERS) -> DataFrame:
    """What several readers make of each line: a deterministic slip in about a third of them."""
    each = lines.withColumn("reader", F.explode(F.array(*map(F.lit, readers))))
    slip = F.substring(F.md5(F.concat_ws(":", "doc_id", "line", "reader")), 1, 1)
    read = (
        F.when(slip == "0", F.translate("text", "e", "c"))
        .when(slip == "1", F.replace("text", F.lit(" "), F.lit("")))
        .when(slip == "2", capitals("text"))
        .when(slip == "3", F.translate("text", ".", ","))
        .when(slip == "4", F.lit(""))
        .otherwise(F.col("text"))
    )
    return each.withColumn("reading", read)


#: The same two tables for DuckDB.
LINES_SQL = """lines AS (SELECT doc_id, lang, source, i - 1 AS line, l AS text FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
READINGS_SQL = (
    LINES_SQL
    + """, readings AS (SELECT *, CASE slip WHEN '0' THEN translate(text, 'e', 'c') WHEN '1' THEN replace(text, ' ', '') WHEN '2' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
  WHEN '3' THEN translate(text, '.', ',') WHEN '4' THEN '' ELSE text END AS reading
  FROM (SELECT *, substr(md5(concat_ws(':', doc_id, line, reader)), 1, 1) AS slip FROM lines, (VALUES ('layer'), ('glm'), ('tess')) r(reader)))"""
)


class Blocks(HTMLParser):
    """Block elements of a page in order; what stands in dropped tags or classes is left out."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "wbr"}

    def __init__(self, drop_tags: set[str], drop_classes: set[str]):
        super().__init__(convert_charrefs=True)
        self.drop_tags, self.drop_classes = drop_tags, drop_classes
        self.out: list[tuple[str, str]] = []
        self.tag, self.parts, self.hidden = "p", [], []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((self.tag, text))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        classes = set((dict(attrs).get("class") or "").split())
        if self.hidden or tag in self.drop_tags or classes & self.drop_classes:
            self.hidden.append(tag)
        elif tag in BLOCK_TAGS:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif tag in BLOCK_TAGS:
            self.flush()
            self.tag = "p"

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_blocks(pages: DataFrame, drop_tags: set[str] = APPARATUS, drop_classes: set[str] = frozenset({"ad"})) -> DataFrame:
    """page_id, block, tag, text of each block of each page, apparatus left out. A worker holds the blocks of ``PAGES`` pages at a time."""
    form = pa.schema([("page_id", pa.int64()), ("block", pa.int64()), ("tag", pa.string()), ("text", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES):
                rows = []
                part = batch.slice(k, PAGES)
                for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    parser = Blocks(set(drop_tags), set(drop_classes))
                    parser.feed(html or "")
                    parser.close()
                    parser.flush()
                    rows += [(page, i, tag, text) for i, (tag, text) in enumerate(parser.out)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(form)], schema=form)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(each, "page_id long, block long, tag string, text string")


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines. A torn last line is dropped; a torn line elsewhere is an error."""
    raw = spark.read.text(path).where("value <> ''")
    parsed = raw.select(
        F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"}).alias("r"),
        F.col("_metadata.file_path").alias("_file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_at"),
    )
    last = parsed.groupBy("_file").agg(F.max("_at").alias("_last"))
    # the condition names both sides of the join, so it is tested after it
    torn = F.col("r._torn").isNotNull()
    whole = F.when(torn & (F.col("_at") < F.col("_last")), F.raise_error(F.lit("a line in the middle of the log is torn")).cast("boolean")).otherwise(~torn)
    return parsed.join(last, "_file").where(whole).select("r.*").drop("_torn")
