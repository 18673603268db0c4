"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as driver  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
from modspark import catalog  # noqa: E402

QUERIES, CHECKS = catalog.QUERIES, catalog.CHECKS
SLOW = {"trained_scorer", "kfold_oof", "stacked_decision"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    return value


def bag(rows, order):
    return Counter(repr(tuple(canonical(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(CHECKS)))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(CHECKS[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = bag(df.collect(), [df.columns.index(c) for c in cols])
    assert got == bag(want.fetchall(), [want.columns.index(c) for c in cols])


@pytest.mark.parametrize("name", sorted(SLOW))
def test_trained_queries_run(spark, name):
    assert name in QUERIES and QUERIES[name](spark, FOLDER).count() > 0


def test_every_query_has_a_check_or_is_trained():
    assert set(QUERIES) - set(CHECKS) == SLOW


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and {"status", "severity", "detected_language", "messages", "labelled", "accuracy"} == set(rows[0].asDict())
    assert sum(r.messages for r in rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
