"""Scenario runs: tags, top tag, flag per row and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions import scores as S
from modspark.functions.maths import fixed
from modspark.operators.tables import align_predictions


def scenario_results(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """Detected tags at 0.50, top tag with its percentage, flag at the safe cut."""
    col = F.col(scores)
    detected = F.array_compact(
        F.array(
            *[
                F.when(
                    col[i] >= k.DEFAULT_TAG_THRESHOLD,
                    F.concat(F.lit(t.upper() + "("), fixed(col[i] * 100, 0), F.lit("%)")),
                )
                for i, t in enumerate(k.LABELS)
            ]
        )
    )
    return scored.withColumn("detected_tags", F.array_join(detected, ", ")).withColumn(
        "top_score",
        F.concat(
            F.upper(S.top_tag(col)), F.lit(": "), fixed(F.array_max(col) * 100, 1), F.lit("%")
        ),
    ).withColumn("flagged", S.is_toxic(F.array_max(col)))


def summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("flagged").alias("toxic"),
        F.count_if(~F.col("flagged")).alias("safe"),
    )


def compare_policies(scores: Column, calibrated: dict[str, float], flat: float = 0.15) -> Column:
    """Both tag lists and whether only the looser policy catches the row."""
    strict = S.tag_triggers(scores, calibrated)
    loose = S.tag_triggers(scores, flat)
    return F.struct(
        F.array_join(strict, ", ").alias("calibrated"),
        F.array_join(loose, ", ").alias("flat"),
        ((F.size(strict) == 0) & (F.size(loose) > 0)).alias("only_flat"),
    )


def two_model_rows(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Predictions of two models as shown strings (at most 32 characters) and flags.

    Each side is ``(row_id, shown, flagged)``; rows only one model saw stay visible.
    """
    short = lambda c: F.when(F.length(c) > 32, F.concat(F.substring(c, 1, 29), F.lit("..."))).otherwise(c)
    both = align_predictions(a, b, row_id)
    return both.select(
        row_id,
        short(F.col("a_shown")).alias("first_prediction"),
        short(F.col("b_shown")).alias("second_prediction"),
        F.coalesce("a_flagged", F.lit(False)).alias("first_flagged"),
        F.coalesce("b_flagged", F.lit(False)).alias("second_flagged"),
    )


def two_model_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("first_flagged").alias("first_toxic"),
        F.count_if("second_flagged").alias("second_toxic"),
    )
