"""Operators that return whole rows leave columns of any name as they are."""

from modspark.llm.exact import exact_dedup
from modspark.llm.suffix import cut_passages

NAMES = "doc_id long, text string, ord_ string, key_ long, ord string, key string, kept_text string, kept_id_ long, kept_sha_ string, row string"
REST = ("o", 1, "p", "q", "r", 2, "s", "t")


def test_cut_passages(spark):
    long_ = "a passage of well over fifty bytes that two documents have in common"
    rows = [(1, long_, *REST), (2, f"{long_} and more", *REST), (3, None, *[None] * 8)]
    docs = spark.createDataFrame(rows, NAMES)
    out = cut_passages(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, " and more", *REST), (3, "", *[None] * 8)]


def test_exact_dedup(spark):
    rows = [(1, "a b", *REST), (2, "ab", *REST), (3, "c", *[None] * 8), (3, "c", *[None] * 8)]
    docs = spark.createDataFrame(rows, NAMES)
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
