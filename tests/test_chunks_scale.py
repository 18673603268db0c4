"""Chunks of a long text take time in proportion to its words."""

import time

from pyspark.sql import functions as F

from modspark.functions import registry
from modspark.functions import text as T
from modspark.operators import tables


def test_long_texts_are_cut_once(spark):
    registry.register(spark)
    long = "w " * 20_000 + "end"  # cut again for every word, this takes minutes
    rows = [(1, long), (2, "a  b"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "i long, t string")
    began = time.time()
    col = df.select("i", F.posexplode(T.word_chunks(F.col("t"))).alias("seq", "chunk"))
    df.createOrReplaceTempView("long_texts")
    sql = spark.sql("SELECT i, seq, chunk FROM long_texts, LATERAL mod_chunks(t)")
    whole = tables.assemble_chunks(col, "i", "seq", "chunk", "t", {"n": F.count(F.lit(1))}).collect()
    assert sorted((r.i, r.t, r.n) for r in whole) == [(1, long, 20_001), (2, "a  b", 3), (3, "", 1)]
    assert col.exceptAll(sql).isEmpty() and sql.exceptAll(col).isEmpty()
    assert time.time() - began < 25
