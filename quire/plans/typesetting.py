"""From lines to paragraphs: reflow, hyphens, quotes, spans, blocks compared, and an EPUB of the result."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.align import opcodes
from ..functions.text import spliced
from ..operators.joins import islands
from ..registry import query
from ..sources.tables import LINES_SQL, lines, table

OPEN, CLOSE = {"“": "”", "‘": "’", "„": "”", "«": "»"}, {"”", "’", "»"}


@query(
    f"""WITH {LINES_SQL}, f AS (SELECT *, lag(text) OVER w AS prev FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR regexp_matches(prev, '[.!?]$') AND length(prev) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS para FROM f)
    SELECT doc_id, CAST(para AS BIGINT) AS para, count(*) AS n_lines, md5(string_agg(text, ' ' ORDER BY line)) AS text_md5 FROM g GROUP BY doc_id, para"""
)
def reflow_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph ends at a short line that closes a sentence."""
    w = Window.partitionBy("doc_id").orderBy("line")
    rows = lines(table(spark, sf_dir, "documents")).withColumn("prev", F.lag("text").over(w))
    new = F.col("prev").isNull() | (F.col("prev").rlike("[.!?]$") & (F.length("prev") < 60))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return islands(rows, ["doc_id"], ["line"], new, "para").groupBy("doc_id", "para").agg(F.count("*").alias("n_lines"), F.md5(text).alias("text_md5"))


def hyphen_joins(broken: DataFrame, spelled: DataFrame) -> DataFrame:
    """head, tail, joined: a word cut at a line's end is put together as the book spells it elsewhere, whole before
    hyphenated; what it spells nowhere is put together whole. Spellings are joined by word: they grow with the corpus."""
    cut = broken.withColumn("whole", F.concat("head", "tail")).withColumn("kept", F.concat_ws("-", "head", "tail"))
    n = spelled.select("word", "n")
    out = cut.join(n.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(n.select(F.col("word").alias("kept"), F.col("n").alias("n_kept")), "kept", "left")
    better = F.coalesce("n_kept", F.lit(0)) > F.coalesce("n_whole", F.lit(0))
    return out.withColumn("joined", F.when(better, F.col("kept")).otherwise(F.col("whole")))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), s AS (SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '^[a-z]{6,}$') GROUP BY word HAVING count(*) >= 3),
    b AS (SELECT word, n, substr(word, 1, 3) AS head, substr(word, 4) AS tail FROM s) SELECT head, tail, word AS joined FROM b"""
)
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, cut after three letters, is found again."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[a-z]{6,}$"))
    s = w.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")
    broken = s.select(F.substring("word", 1, 3).alias("head"), F.expr("substring(word, 4)").alias("tail"))
    return hyphen_joins(broken, s).select("head", "tail", "joined")


def quote_faults(text: str) -> list[tuple[int, str]]:
    """Places of quotation marks without a partner; an apostrophe inside a word is no mark."""
    stack, out = [], []
    for i, x in enumerate(text):
        inside = 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()
        if x in OPEN:
            stack.append((i, OPEN[x]))
        elif x in CLOSE and not (x == "’" and inside):
            if stack and stack[-1][1] == x:
                stack.pop()
            elif x != "’":
                out.append((i, "not opened"))
    return sorted(out + [(i, "not closed") for i, _ in stack])


# Words that open with an apostrophe.
ELIDED = ("t", "k", "n", "s", "m", "r", "em", "tis", "twas", "twere", "twill", "til", "cause")


def curled(text: str) -> str:
    """Straight marks turned: opening after a blank, a dash or an opening bracket, else closing. An apostrophe that opens an elided
    word closes; feet and inches after a number, and marks between blanks, stay straight."""
    padded = f" {text} "

    def one(i: int) -> str:
        mark, before, after = padded[i], padded[i - 1], padded[i + 1]
        opens = before.isspace() or before in "(—–[“‘"
        if before.isdigit() and not after.isalnum() or before.isspace() and after.isspace():
            return mark
        if mark == '"':
            return "“" if opens else "”"
        word = re.match(r"\w*", padded[i + 1 :])[0].lower()
        return "‘" if opens and word and word not in ELIDED else "’"

    return "".join(one(i) if padded[i] in "\"'" else padded[i] for i in range(1, len(padded) - 1))


@query()
def quote_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks are put around a word of each line and one in five loses its partner; what is missing is found again."""
    t = F.when(F.length("text") > 20, F.concat(F.lit('"'), F.substring("text", 1, 12), F.when(F.substring(F.md5("text"), 1, 1) < "3", "").otherwise('"'), F.expr("substring(text, 13)"))).otherwise(F.col("text"))
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", t.alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(d, n, at, what) for d, n, text in batch.itertuples(index=False) for at, what in quote_faults(curled(text))]
            yield pd.DataFrame(found, columns=["doc_id", "line", "at", "fault"])

    return rows.mapInPandas(each, "doc_id long, line long, at long, fault string")


@query(
    """SELECT doc_id, md5('<<' || substr(text, 1, 3) || '>>' || substr(text, 6, 4) || '#' || substr(text, 11)) AS spliced FROM documents WHERE length(text) >= 20"""
)
def splice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans replaced from right to left, one of them empty."""
    spans = F.expr("array(named_struct('s', 9, 'e', 10, 'new', '#'), named_struct('s', 0, 'e', 0, 'new', '<<'), named_struct('s', 3, 'e', 5, 'new', '>>'))")
    return table(spark, sf_dir, "documents").where("length(text) >= 20").select("doc_id", F.md5(spliced("text", spans)).alias("spliced"))


def block_diff(old: DataFrame, new: DataFrame, by: str = "book") -> DataFrame:
    """Blocks of two builds aligned: changed, added and removed ones. Expects (book, n, text); one book is one
    sequence, and goes through as arrays of hashes, so a long text does not weigh."""
    gather = lambda df, name: df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("text").alias("h")))).alias(name))
    both = gather(old, "a").join(gather(new, "b"), by, "full_outer")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, a, b in zip(batch[by], batch["a"], batch["b"]):
                a, b = list(a) if a is not None else [], list(b) if b is not None else []
                for tag, a0, a1, b0, b1 in opcodes([x["h"] for x in a], [x["h"] for x in b]):
                    if tag == "equal":
                        continue
                    for k in range(max(a1 - a0, b1 - b0)):
                        x, y = (a[a0 + k]["n"] if a0 + k < a1 else None), (b[b0 + k]["n"] if b0 + k < b1 else None)
                        out.append((key, "changed" if x is not None and y is not None else "removed" if y is None else "added", x, y))
            frame = pd.DataFrame(out, columns=[by, "change", "old_n", "new_n"])
            yield frame.astype({"old_n": "Int64", "new_n": "Int64"})

    return both.mapInPandas(each, f"{by} string, change string, old_n long, new_n long")


@query()
def build_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("book"), F.col("line").alias("n"), "text")
    new = rows.where("n <> 2").withColumn("text", F.when(F.col("n") == 1, F.upper("text")).otherwise(F.col("text")))
    return block_diff(rows, new)


def epub(title: str, sections: list[tuple[str, list[str]]]) -> bytes:
    """An EPUB 3: the type first and stored, one file for each section; the same bytes for the same content."""
    names = [f"s{i}.xhtml" for i in range(len(sections))]
    body = lambda head, paras: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(head)}</title></head><body><h1>{escape(head)}</h1>' + "".join(f"<p>{escape(p)}</p>" for p in paras) + "</body></html>"
    items = "".join(f'<item id="s{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    package = f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>' + "".join(f'<itemref idref="s{i}"/>' for i in range(len(names))) + "</spine></package>"
    nav = '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{escape(h)}</a></li>' for n, (h, _) in zip(names, sections)) + "</ol></nav></body></html>"
    files = [("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'), ("content.opf", package), ("nav.xhtml", nav)]
    files += [(n, body(h, p)) for n, (h, p) in zip(names, sections)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip", zipfile.ZIP_STORED)
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epub_books(blocks: DataFrame) -> DataFrame:
    """book, epub from (book, n, heading, text): sections begin at headings. A book is one file, so one row."""
    gathered = blocks.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("n", "heading", "text"))).alias("b"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for book, rows in zip(batch["book"], batch["b"]):
                sections: list[tuple[str, list[str]]] = []
                for r in rows:
                    if r["heading"] or not sections:
                        sections.append((r["text"] if r["heading"] else book, []))
                    if not r["heading"]:
                        sections[-1][1].append(r["text"])
                out.append((book, epub(book, sections)))
            yield pd.DataFrame(out, columns=["book", "epub"])

    return gathered.mapInPandas(each, "book string, epub binary")


@query()
def epub_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a book, a section for each turn of its user; the digest of every file."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("n"), (F.col("role") == "user").alias("heading"), "text")
    return epub_books(c).select("book", F.length("epub").cast("long").alias("n_bytes"), F.sha2("epub", 256).alias("sha256"))
