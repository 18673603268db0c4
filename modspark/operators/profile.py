"""Corpus profile: value counts, class weights, lengths, scripts, report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions.lang import char_classes
from modspark.functions.maths import fixed, round_exact
from modspark.functions.text import word_count


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value, largest first.

    The total is a scalar subquery over the same aggregate, which the planner reuses.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100.0).orderBy(
        F.desc("n"), column
    )


def class_weights(df: DataFrame, tags: Sequence[str], cap: float = 25.0) -> DataFrame:
    """Positives, negatives, rate and clamped weight per tag from one aggregate row."""
    sums = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(t).cast("long")).alias(t) for t in tags]
    )
    long = sums.select(
        "_n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(t).alias("tag"), F.coalesce(F.col(t), F.lit(0)).alias("positives"))
                    for t in tags
                ]
            )
        ),
    )
    negatives = F.col("_n") - F.col("positives")
    ratio = round_exact(negatives / F.greatest(F.lit(1), F.col("positives")), 2)
    return long.select(
        "tag",
        "positives",
        negatives.alias("negatives"),
        round_exact(F.col("positives") / F.col("_n") * 100.0, 2).alias("rate_pct"),
        F.least(F.lit(cap), F.greatest(F.lit(1.0), ratio)).alias("weight"),
    )


def length_profile(df: DataFrame, text: str, exact: bool = True) -> DataFrame:
    """Mean, median, 95th percentile and maximum of characters and words.

    Lengths are counted first, so the exact percentiles (linear interpolation) work on
    (length, frequency) pairs and their state grows with the distinct lengths only.
    """
    lengths = df.select(
        F.inline(
            F.array(
                F.struct(F.lit("characters").alias("unit"), F.length(text).cast("long").alias("v")),
                F.struct(F.lit("words").alias("unit"), word_count(F.col(text)).cast("long").alias("v")),
            )
        )
    )
    freq = lengths.groupBy("unit", "v").agg(F.count(F.lit(1)).alias("f"))

    def pct(p: float):
        if exact:
            return F.percentile("v", p, F.col("f"))
        return F.percentile_approx("v", p).cast("double")

    return (freq if exact else lengths.withColumn("f", F.lit(1))).groupBy("unit").agg(
        (F.sum(F.col("v") * F.col("f")) / F.sum("f")).alias("mean"),
        pct(0.5).alias("median"),
        pct(0.95).alias("p95"),
        F.max("v").alias("max"),
    )


def script_ratio(df: DataFrame, text: str) -> DataFrame:
    """Corpus share of ASCII, Devanagari and other characters in percent."""
    c = df.select(char_classes(F.col(text)).alias("c")).select("c.*")
    sums = c.agg(
        *[F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0)).alias(n) for n in ("ascii", "devanagari", "total")]
    )
    total = F.greatest(F.lit(1), F.col("total"))
    return sums.select(
        "ascii",
        "devanagari",
        (F.col("total") - F.col("ascii") - F.col("devanagari")).alias("other"),
        "total",
        (F.col("ascii") * 100.0 / total).alias("ascii_pct"),
        (F.col("devanagari") * 100.0 / total).alias("devanagari_pct"),
        (100.0 - F.col("ascii") * 100.0 / total - F.col("devanagari") * 100.0 / total).alias("other_pct"),
    )


def profile_lines(df: DataFrame, text: str, source: str, tags: Sequence[str] = tuple(k.LABELS)) -> DataFrame:
    """Markdown report as ``(line_no, line)`` rows; only aggregates feed the numbering."""
    counts = value_counts(df, source).select(
        F.lit(2).alias("section"),
        F.row_number().over(Window.orderBy(F.desc("n"), source)).alias("pos"),
        F.format_string("| `%s` | %d | %s%% |", F.col(source), F.col("n"), fixed(F.col("pct"), 1)).alias("line"),
    )
    weights = class_weights(df, tags).select(
        F.lit(4).alias("section"),
        F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag")).cast("int").alias("pos"),
        F.format_string(
            "| `%s` | %d | %d | %s%% | %s |",
            "tag", "positives", "negatives", fixed(F.col("rate_pct"), 2), fixed(F.col("weight"), 2),
        ).alias("line"),
    )
    lengths = length_profile(df, text).select(
        F.lit(6).alias("section"),
        F.when(F.col("unit") == "characters", 1).otherwise(2).alias("pos"),
        F.format_string(
            "| %s | %s | %s | %s | %d |",
            "unit", *[fixed(F.col(x), 1) for x in ("mean", "median", "p95")], "max",
        ).alias("line"),
    )
    heads = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), F.lit(p).alias("pos"), line.alias("line"))
                    for s, p, line in (
                        (0, 1, F.format_string("# Corpus profile, %d rows", F.col("n"))),
                        (1, 1, F.lit("| source | rows | share |")),
                        (1, 2, F.lit("|---|---|---|")),
                        (3, 1, F.lit("| tag | positives | negatives | rate | weight |")),
                        (3, 2, F.lit("|---|---|---|---|---|")),
                        (5, 1, F.lit("| unit | mean | median | p95 | max |")),
                        (5, 2, F.lit("|---|---|---|---|---|")),
                    )
                ]
            )
        )
    )
    return heads.unionByName(counts).unionByName(weights).unionByName(lengths)
