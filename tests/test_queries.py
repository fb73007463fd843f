"""Every registered query outside the llm package against its SQL, on the smallest tables."""

import duckdb
import pytest

import quire.plans  # noqa: F401
from quire.registry import ORACLE_SQL, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 5))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"arbiter_scores"}))
def test_runs(spark, name):
    QUERIES[name](spark, SMALL).collect()


def test_arbiter_scores_every_version(spark):
    """Each line of every book is scored, its versions share one, and right versions have the higher chance."""
    from quire.plans.fusion import read

    got = QUERIES["arbiter_scores"](spark, SMALL).toPandas()
    assert len(got) == read(spark, SMALL).count()
    assert ((got.groupby(["doc_id", "line"])["share"].sum() - 1).abs() < 1e-6).all()
    assert got[got["label"] == 1]["chance"].mean() > got[got["label"] == 0]["chance"].mean() + 0.2


def test_bench_takes_the_queries_there_are():
    from bench import timed

    assert timed({"opening_habits": 0, "op10_b": 0, "op2_a": 0, "pipeline": 0, "page_counts": 0}) == ["page_counts", "op2_a", "op10_b", "pipeline"]
