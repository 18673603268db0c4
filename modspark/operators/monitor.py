"""Operations tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ops_metrics(
    log: DataFrame, ts: str, latency: str, window: str, by: Sequence[str], exact: bool = True
) -> DataFrame:
    """Requests, p50 and p95 per tumbling window and group.

    Exact percentiles are taken over (latency, frequency) pairs counted map-side; with
    latencies in whole or hundredth milliseconds their number is bounded by the range.
    """
    slot = F.window(ts, window)["start"].alias("window_start")
    if not exact:
        return log.groupBy(slot, *by).agg(
            F.count(F.lit(1)).alias("requests"),
            F.percentile_approx(latency, 0.5, 10_000).alias("p50"),
            F.percentile_approx(latency, 0.95, 10_000).alias("p95"),
        )
    freq = log.groupBy(slot, *by, latency).agg(F.count(F.lit(1)).alias("_f"))
    return freq.groupBy("window_start", *by).agg(
        F.sum("_f").alias("requests"),
        F.percentile(latency, 0.5, F.col("_f")).alias("p50"),
        F.percentile(latency, 0.95, F.col("_f")).alias("p95"),
    )


SKETCH_K = 800
# Bound on the difference between the wanted and the true share of rows at or below an answer: over twice what
# sketches of this size keep in 99 of 100 cases.
RANK_ERROR = 0.01


def latency_sketches(log: DataFrame, ts: str, latency: str, window: str, by: Sequence[str]) -> DataFrame:
    """``window_start, by, requests, sketch``: a mergeable quantile sketch per tumbling window and group.

    A sketch takes some kilobytes however many rows or values a group has; partial sketches leave the tasks. Groups of up to
    ``SKETCH_K`` rows are exact. Null latencies count as requests only; a row without a time belongs to no window.
    """
    slot = F.window(ts, window)["start"].alias("window_start")
    return log.groupBy(slot, *by).agg(
        F.count(F.lit(1)).alias("requests"), F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(SKETCH_K)).alias("sketch")
    )


def roll_up(sketches: DataFrame, window: str, by: Sequence[str]) -> DataFrame:
    """The same table for longer windows (minutes to hours, hours to days) or fewer groups, without the rows."""
    slot = F.window("window_start", window)["start"]
    return sketches.groupBy(slot.alias("_slot"), *by).agg(
        F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch")
    ).withColumnRenamed("_slot", "window_start")


def sketched_percentiles(sketches: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """A column for each share, null for a group without latencies; its rank is within ``RANK_ERROR`` of the wanted one."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        *[F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).alias(name) for name, share in shares.items()],
    )


def count_by(log: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts per value of each dimension as (dimension, value, n), one pass."""
    entries = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    )
    return log.select(F.inline(entries)).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def hashed_id(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)
