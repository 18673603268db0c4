"""Session helpers: test session, shared scratch folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("modspark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, named by ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="modspark-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only after looking at ``max_rows + 1`` rows at most.

    ``take`` reads partitions step by step and stops at the bound.  A side over
    it keeps no hint: the join shuffles and AQE splits skew.
    """
    n = len(df.select(F.lit(1)).take(max_rows + 1))
    return F.broadcast(df) if n <= max_rows else df


def _in_few_splits(df: DataFrame, cores: int) -> bool:
    """Does one split hold over twice an even share of the rows?

    A Parquet row group is read by one split: a large file of one row group has many splits, all but one without
    rows. Rows are counted from the footers; no column is read.
    """
    counts = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return total is not None and most * cores > 2 * total


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for row-heavy work on a table whose rows arrive in very few splits.

    A table whose rows already lie in at least as many splits as cores is returned as it is, so at scale
    nothing is shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and not _in_few_splits(df, cores):
        return df
    n = -(-splits // cores) * cores
    return df.repartition(n, *keys) if keys else df.repartition(n)
