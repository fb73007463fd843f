import pytest
from pyspark.sql import functions as F

from ..conftest import SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_equal_their_operators_one_by_one(spark):
    """Each stage on what the one before kept: rows only go for the stage's own reason."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SMALL)
        if name == "packing":
            assert after.agg(F.countDistinct("doc_id")).first()[0] == before.count()
            assert after.count() == corpus_pipeline.run(spark, SMALL).count()
            break
        assert after.columns == docs.columns
        kept, had = ({r.doc_id for r in d.select("doc_id").collect()} for d in (after, before))
        assert kept <= had and after.count() == len(kept)
        if name == "quality":
            good = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
            assert len(kept & good) > 0.95 * len(good)
        if name == "personal_data":
            assert kept == had and after.where("text rlike '@mail[0-9]'").count() == 0
        before = after


def test_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL) if name != "quality" else None
        if name not in ("quality", "packing"):
            docs = out
        elif out is not None:
            assert out.count() > 0


def test_rows_without_an_id_stay(spark, odd):
    """Of the odd rows without an id one has a text that nothing is like."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns and [r.text[:7] for r in kept.where("doc_id IS NULL").collect()] == ["null id"]


def test_documents_without_an_id_are_decontaminated(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, "before " + item + " after", "en", "s", 1), (None, "clean words " * 30, "en", "s", 1), (4, item, "en", "s", 1), (4, "other clean words " * 30, "en", "s", 1), (5, None, "en", "s", 1)]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL)
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "clean"), (4, "other"), (5, "")]


def test_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = out if name != "packing" else docs
