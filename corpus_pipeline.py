"""A corpus pipeline of five stages: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Edge cases. Null and empty texts, and those without words, go with the quality stage; without labelled documents of two grades it keeps
the others. Documents with null ids pass all stages like others: copies and contaminated texts are told by the text. Rows with one
id and different texts are documents of their own; repeated rows are copies. Very long texts are read whole. Where two
documents of a group have the same id, the one with the lower hash of its text stays. An empty table gives an empty result with
the stage's columns. Further columns of the input, whatever their names, are dropped by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, drop_cut, free_name, table
from quire.llm.decontaminate import leaks
from quire.llm.packing import pack
from quire.llm.pii import redact
from quire.llm.quality import fitted, grade
from quire.llm.simhash import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely the highest; the model is fitted on the labelled ones of them."""
    graded = grade(docs.select(*COLUMNS), fitted(docs, table(spark, sf_dir, "labels")))
    return graded.where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; one without an id stays if its group has none with one."""
    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Texts are told apart by their hash, so ids may be null or repeated."""
    digest = free_name(docs, "digest")
    rows = docs.select(*COLUMNS).withColumn(digest, F.xxhash64("text"))
    found = leaks(rows, table(spark, sf_dir, "benchmark"), id_col=digest).select(F.col("doc_id").alias(digest)).distinct()
    return rows.join(found, digest, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    text = free_name(docs, "before")
    out = redact(docs.select(*COLUMNS, F.col("text").alias(text)))
    changed = ~F.col("text").eqNullSafe(F.col(text))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fingerprints, latent vectors and tokens have no DuckDB equivalent; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
