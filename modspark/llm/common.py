"""What the operators share: narrow inputs and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes in here go when it ends, but those stored with ``keep``: nothing that is
    evaluated later may read the others."""
    paths: list[str] = []
    before = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(before)
        conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        for path in map(path_of, paths):
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    paths = _passing.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key() -> Column:
    """Tells rows that share a doc_id (or have none) but not a text apart."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.col("text"))
