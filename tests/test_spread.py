"""Rows of a large file with one row group lie in one of its many splits."""

import random

from pyspark.sql import functions as F

from modspark.catalog.common import documents
from modspark.session import spread


def _by_split(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_one_row_group_in_many_splits(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("abcdefghijklmnop qrstuvwxyz", k=4000))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        raw = spark.read.parquet(f"{tmp_path}/documents.parquet")
        cores = spark.sparkContext.defaultParallelism
        assert raw.rdd.getNumPartitions() >= cores and _by_split(raw) == [2000]
        out = documents(spark, str(tmp_path), "doc_id", "text")
        assert max(_by_split(out)) < 2 * 2000 / cores
        assert out.exceptAll(raw).isEmpty() and out.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_in_even_splits_stay_where_they_are(spark):
    df = spark.range(0, 10_000, 1, 16).toDF("doc_id")
    assert spread(df, "doc_id") is df
    assert spread(df.where("doc_id < 0"), "doc_id").count() == 0
