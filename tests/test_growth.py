"""Queries that must not grow faster than their input: what their plans read, send and keep, and their results on odd rows."""

import re

import quire.plans  # noqa: F401  fills the registry
from quire.registry import QUERIES

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_arbiter_reads_the_documents_once(spark):
    """Features are written before the training, so nothing later reads a text."""
    assert not [f for f in QUERIES["arbiter_scores"](spark, SMALL).inputFiles() if "documents" in f]


def test_arbiter_features_equal_plain_counts(spark):
    from quire.plans.fusion import features

    texts = ["", " ", "A, b. ée", "Ünder\tTHE  sea...", "𝒳 ̀́ e,e", "\n x \r"]
    rows = spark.createDataFrame([("s", i, 0, "glm", t, t) for i, t in enumerate(texts)], "source string, doc_id long, line long, reader string, reading string, text string")
    for r in features(rows).collect():
        t = texts[r.doc_id]
        share = lambda k: k / len(t) if t else 0.0
        assert (r.f_length, r.f_words, r.f_commas, r.f_stops, r.f_e) == (len(t), len(re.findall(r"\S+", t)), t.count(","), t.count("."), t.count("e"))
        assert (r.f_upper, r.f_dense) == (share(len(re.findall("[A-Z]", t))), share(len(re.sub("[ ̀-ͯ]", "", t))))


def test_words_of_pages_are_not_shuffled(spark):
    """Word lists are written first and go to the pages; only counts of pages are sent."""
    for name in ("language_by_lexicon", "lexicon_verdicts"):
        assert "hashpartitioning(word" not in plan(QUERIES[name](spark, SMALL)), name


def test_html_blocks_hold_few_pages_at_a_time(spark, monkeypatch):
    """A worker gives out the blocks of 64 pages at a time, whatever comes in."""
    import pyarrow as pa

    from quire.sources import tables

    seen = {}

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, each, _):
            seen["each"] = each

    tables.html_blocks(Pages())
    page = "<nav>x</nav><h1>a  b</h1><p>c</p>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": [page] * 999 + [None]})
    out = list(seen["each"](iter([batch])))
    assert max(b.num_rows for b in out) <= 2 * 64
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, *x) for i in range(999) for x in ((0, "h1", "a b"), (1, "p", "c"))]


def test_settled_numbers_equal_a_fold_in_order(spark):
    import random

    from quire.plans.sequences import settled_numbers

    r = random.Random(4)
    runs = {key: [r.choice((i, i, i + 1, i + 3, 7, -2)) for i in range(r.randint(1, 30))] for key in (None, *range(200))}
    rows = spark.createDataFrame([(key, n, x) for key, run in runs.items() for n, x in enumerate(run)], "k long, n long, read long")
    want = []
    for key, run in runs.items():
        last = None
        for i, x in enumerate(run):
            good = last is None or x == last + 1 or (i + 1 < len(run) and run[i + 1] == x + 1)
            last = x if good else last + 1
            want.append((key, i, x, last))
    out = settled_numbers(rows, "k")
    order = lambda t: (t[0] is None, *map(str, t))
    assert sorted(map(tuple, out.collect()), key=order) == sorted(want, key=order)
    assert "InPandas" not in plan(out) and "collect_list" not in plan(out)


def exchanges(df):
    df.collect()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan(df).split("Initial Plan")[0])


def test_words_by_line_sends_words_once(spark):
    assert not [x for x in exchanges(QUERIES["words_by_line"](spark, SMALL)) if re.search(r"doc_id#\d+L?, word#", x)]


def test_benchmark_alignment_sends_no_page(spark):
    """Neither all shingles nor the words of pages are sent, only the ids of the pages that met."""
    df = QUERIES["benchmark_alignment"](spark, SMALL)
    assert [x.count(",") for x in exchanges(df) if "doc_id" in x] == [1]


def test_readings_are_grouped_where_their_page_lies(spark):
    for name in ("suspect_votes", "version_union"):
        assert len(exchanges(QUERIES[name](spark, SMALL))) == 1, name


def test_suspect_votes_of_a_page_given_twice(spark, tmp_path):
    """Votes of equal pages add up, and ties go by the readers' names as in the SQL."""
    import duckdb

    from quire.registry import ORACLE_SQL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    docs.union(docs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["suspect_votes"](spark, str(tmp_path)).select("doc_id", "line", "chosen", "votes", "readers", "versions").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL["suspect_votes"]).fetchall())
