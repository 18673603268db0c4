"""Exact positions, running totals and smallest-n without a single-task window.

Rows are cut into deterministic order-preserving buckets.  Bucket totals are
pre-aggregated (map-side combine) and turned into running offsets over the few bucket
rows; only the inside of one bucket is ever sorted together.  A group that holds a
third of the table is therefore spread over all its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536
_B = "_bucket"
_G = "_group"


def seeded_hash(seed: int, *cols: Column) -> Column:
    """Portable hash order: hex md5 of ``seed|a|b``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """First hex digits: 65,536 even buckets in hash order, a million with five digits."""
    return F.substring(h, 1, digits)


def range_bucket(df: DataFrame, order: Column, buckets: int = BUCKETS) -> Column:
    """Equal-width buckets of a numeric order, bounds from a scalar subquery."""
    bounds = df.agg(F.struct(F.min(order).alias("lo"), F.max(order).alias("hi"))).scalar()
    width = F.floor((bounds["hi"] - bounds["lo"]) / buckets) + 1
    return F.floor((order - bounds["lo"]) / width)


def group_of(keys: Sequence[str]) -> Column:
    """One never-null group value; null keys form a group of their own."""
    return F.struct(*keys) if keys else F.lit(0)


def bucket_offsets(
    df: DataFrame, keys: Sequence[str], bucket: Column, measures: Mapping[str, Column]
) -> DataFrame:
    """Per (group, bucket): totals and the totals of all earlier buckets.

    The window sees one row per bucket, at most ``BUCKETS`` per group.
    """
    per = df.groupBy(group_of(keys).alias(_G), bucket.alias(_B)).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    w = Window.partitionBy(_G).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        _G,
        _B,
        *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in measures],
        *[F.col(n).alias(f"_in_{n}") for n in measures],
    )


def ordinal(
    df: DataFrame, order: Column, bucket: Column, keys: Sequence[str] = (), name: str = "ordinal"
) -> DataFrame:
    """0-based position of every row in ``order`` within its keys.

    ``bucket`` must not decrease along ``order``.
    """
    offs = bucket_offsets(df, keys, bucket, {"n": F.count(F.lit(1))})
    rows = df.withColumn(_G, group_of(keys)).withColumn(_B, bucket)
    w = Window.partitionBy(_G, _B).orderBy(order)
    local = rows.withColumn("_r", F.row_number().over(w))
    out = local.join(offs.drop("_in_n"), [_G, _B])
    return out.withColumn(name, F.col("_before_n") + F.col("_r") - 1).drop(_G, _B, "_r", "_before_n")


def smallest(
    df: DataFrame,
    n: int | str,
    order: Column,
    bucket: Column,
    keys: Sequence[str] = (),
    quotas: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` rows that come first in ``order`` within each key.

    ``n`` may name a column of ``quotas`` (one row per key).  Whole buckets past the
    cut are dropped by the offsets join before anything is sorted.
    """
    offs = bucket_offsets(df, keys, bucket, {"n": F.count(F.lit(1))}).drop("_in_n")
    if quotas is not None:
        offs = offs.join(quotas.select(group_of(keys).alias(_G), F.col(n).alias("_n")), _G)
    else:
        offs = offs.withColumn("_n", F.lit(n).cast("long"))
    offs = offs.filter(F.col("_before_n") < F.col("_n"))
    rows = df.withColumn(_G, group_of(keys)).withColumn(_B, bucket).join(offs, [_G, _B])
    w = Window.partitionBy(_G, _B).orderBy(order)
    return (
        rows.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_before_n") + F.col("_r") <= F.col("_n"))
        .drop(_G, _B, "_r", "_before_n", "_n")
    )
