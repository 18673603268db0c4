"""Moderator feedback: statistics, retrain batches, export, override rate, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions.maths import round_exact, safe_divide
from modspark.operators.ordinal import ordinal, range_bucket

CORRECT = "model_prediction_was_correct"


def feedback_id(message_id: Column) -> Column:
    return F.concat(F.lit("fb-"), F.substring(message_id, 1, 8))


def feedback_stats(
    feedback: DataFrame, last_retrain: Column | None = None, threshold: int = k.RETRAIN_THRESHOLD
) -> DataFrame:
    """One row; rows submitted strictly after ``last_retrain`` count as new."""
    since = (
        F.count(F.lit(1)) if last_retrain is None else F.count_if(F.col("submitted_at") > last_retrain)
    )
    stats = feedback.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(CORRECT)).alias("correct"),
        F.count_if(~F.col(CORRECT)).alias("incorrect"),
        since.alias("since_last_retrain"),
    )
    return stats.select(
        "total",
        "correct",
        "incorrect",
        round_exact(safe_divide(F.col("correct"), F.col("total")), 4).alias("accuracy"),
        "since_last_retrain",
        F.greatest(F.lit(0), F.lit(threshold) - F.col("since_last_retrain")).alias("remaining"),
    )


def retrain_batches(
    feedback: DataFrame, order: str, threshold: int = k.RETRAIN_THRESHOLD
) -> DataFrame:
    """Batch number of every row and the rows that fire a retrain.

    The counter resets at each trigger, so the trigger rows are every ``threshold``-th
    in submission order; the global position comes from bucket offsets.
    """
    placed = ordinal(feedback, F.col(order), range_bucket(feedback, F.col(order)), name="_pos")
    return (
        placed.withColumn("batch", F.floor(F.col("_pos") / threshold))
        .withColumn("fires", (F.col("_pos") + 1) % threshold == 0)
        .drop("_pos")
    )


def retrain_export(
    feedback: DataFrame, exported: DataFrame | None = None, key: str = "message_id", full: bool = False
) -> DataFrame:
    """Incorrect rows that were not exported before; ``full`` exports all again."""
    wrong = feedback.filter(~F.col(CORRECT)).drop("_id")
    if exported is None or full:
        return wrong
    return wrong.join(exported.select(key), key, "left_anti")


def attach_messages(feedback: DataFrame, messages: DataFrame, how: str = "inner") -> DataFrame:
    return feedback.join(messages, "message_id", how)


def override_rate(joined: DataFrame, group: str, predicted: Column) -> DataFrame:
    """Reviews, overrides, and false positives per group."""
    wrong = ~F.col(CORRECT)
    return joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(wrong).alias("overrides"),
        F.round(F.count_if(wrong) / F.count(F.lit(1)), 6).alias("override_rate"),
        F.count_if(wrong & predicted).alias("false_positives"),
        F.count_if(predicted).alias("predicted_positives"),
    )


def review_queue(scored: DataFrame, score: str, cut: float, n: int, row_id: str) -> DataFrame:
    """The ``n`` rows closest to the cut (a top-n report)."""
    return (
        scored.withColumn("margin", F.round(F.abs(F.col(score) - cut), 6))
        .orderBy("margin", row_id)
        .limit(n)
    )


def disagreement(annotations: DataFrame, item: str, label: str) -> DataFrame:
    """Share of annotations that differ from the item's most common label.

    Labels are counted per item first; equal counts resolve to the larger label.
    """
    per = annotations.groupBy(item, label).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(item).agg(
        F.sum("_n").alias("annotations"),
        F.max(F.struct("_n", label))[label].alias("majority"),
        F.round(1 - F.max("_n") / F.sum("_n"), 6).alias("disagreement"),
    )
