"""Evaluation on the long prediction table ``(row_id, tag, y, score)``.

Every curve metric starts by grouping equal scores, so what is sorted is the distinct
scores and not the rows; running totals go through score buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions.maths import fixed, perplexity, round_exact, safe_divide, weighted_bce
from modspark.operators.ordinal import bucket_offsets, group_of

SCORE_BUCKETS = 512


def to_long(
    df: DataFrame, row_id: str, scores: Mapping[str, Column], truth: Mapping[str, Column], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per (row, tag) from wide columns, without a shuffle."""
    entries = F.array(
        *[
            F.struct(
                F.lit(t).alias("tag"),
                truth[t].cast("int").alias("y"),
                scores[t].cast("double").alias("score"),
            )
            for t in scores
        ]
    )
    return df.select(row_id, *keep, F.inline(entries))


def count_scores(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with equal keys, truth and score become one with their number in ``w``.

    All metrics below take such a table.  Computing several of them from one counted
    table runs the scorer once, and the planner reuses the one exchange.
    """
    return long.groupBy(*keys, "y", "score").agg(F.sum(_weight(long)).alias("w"))


def _weight(long: DataFrame) -> Column:
    return F.col("w") if "w" in long.columns else F.lit(1).cast("long")


def _f1(tp: Column, predicted: Column, positive: Column) -> Column:
    return safe_divide(2 * tp, predicted + positive)


def thresholds_frame(spark, thresholds: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(list(thresholds.items()), "tag string, threshold double")


def with_thresholds(
    long: DataFrame, thresholds: DataFrame, default: float = k.DEFAULT_TAG_THRESHOLD
) -> DataFrame:
    """Attach the threshold of each tag.  One row per tag is enforced first; tags are the
    label columns of the wide table, so the broadcast side has one row per label."""
    tags = thresholds.groupBy("tag").agg(F.max("threshold").alias("threshold"))
    return long.join(F.broadcast(tags), "tag", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(default))
    )


def _counts(long: DataFrame, hit: Column | None) -> list[Column]:
    hit = F.col("score") >= k.DEFAULT_TAG_THRESHOLD if hit is None else hit
    pos = F.col("y") == 1
    w = _weight(long)
    cells = {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}
    return [F.sum(F.when(cell, w).otherwise(0)).alias(name) for name, cell in cells.items()]


def confusion(long: DataFrame, keys: Sequence[str] = ("tag",), hit: Column | None = None) -> DataFrame:
    """Counts and precision, recall, F1 (0 where undefined) per key."""
    return _with_ratios(long.groupBy(*keys).agg(*_counts(long, hit)), keys)


def slice_confusion(long: DataFrame, slices: Sequence[str], keys: Sequence[str] = ("tag",), hit: Column | None = None) -> DataFrame:
    """``kind, slice, keys`` and the counts and ratios of ``confusion`` for several slicings at once.

    Each column of ``slices`` cuts all rows anew. All are counted in one pass and one exchange
    (GROUPING SETS over map-side counts). A null value is a slice of its own, with a null name.
    """
    sets = [[name, *keys] for name in slices]
    of = [F.when(F.grouping(name) == 0, F.struct(F.lit(name).alias("kind"), F.col(name).cast("string").alias("slice"))) for name in slices]
    counts = long.groupingSets(sets, *slices, *keys).agg(F.coalesce(*of).alias("_of"), *_counts(long, hit))
    return _with_ratios(counts.select("_of.kind", "_of.slice", *keys, "tp", "fp", "fn", "tn"), ["kind", "slice", *keys])


def _with_ratios(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.select(
        *keys,
        "tp",
        "fp",
        "fn",
        "tn",
        safe_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _f1(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")).alias("f1"),
    )


def macro_micro(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of tag F1 and F1 of the pooled counts."""
    return counts.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        _f1(
            F.sum("tp"), F.sum("tp") + F.sum("fp"), F.sum("tp") + F.sum("fn")
        ).alias("micro_f1"),
    )


def score_curve(long: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """Per key and distinct score: positives and rows at the score and at or above it,
    plus totals per key."""
    keys = list(keys)
    w = _weight(long)
    at = long.groupBy(*keys, "score").agg(
        F.sum(F.col("y").cast("long") * w).alias("pos"), F.sum(w).alias("n")
    )
    bucket = -F.floor(F.col("score") * SCORE_BUCKETS)
    offs = bucket_offsets(at, keys, bucket, {"pos": F.sum("pos"), "n": F.sum("n")})
    totals = Window.partitionBy("_group")
    offs = offs.withColumn("pos_all", F.sum("_in_pos").over(totals)).withColumn(
        "n_all", F.sum("_in_n").over(totals)
    )
    at = at.withColumn("_group", group_of(keys)).withColumn("_bucket", bucket)
    down = (
        Window.partitionBy("_group", "_bucket")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = at.withColumn("_pos", F.sum("pos").over(down)).withColumn("_n", F.sum("n").over(down))
    joined = local.join(offs, ["_group", "_bucket"])
    return joined.select(
        *keys,
        "score",
        "pos",
        "n",
        (F.col("_before_pos") + F.col("_pos")).alias("tp"),
        (F.col("_before_n") + F.col("_n")).alias("pp"),
        "pos_all",
        "n_all",
    )


def roc_auc(long: DataFrame, keys: Sequence[str] = ("tag",), undefined: float | None = None) -> DataFrame:
    """Rank-sum AUC, ties at half weight; ``undefined`` where one class is missing."""
    neg_at = F.col("n") - F.col("pos")
    neg_below = (F.col("n_all") - F.col("pos_all")) - (F.col("pp") - F.col("tp"))
    area = F.sum(F.col("pos") * (2 * neg_below + neg_at))  # twice the area, whole numbers
    per = score_curve(long, keys).groupBy(*keys).agg(
        area.alias("_area"), F.max("pos_all").alias("_p"), F.max("n_all").alias("_n")
    )
    value = F.col("_area") / (2.0 * F.col("_p") * (F.col("_n") - F.col("_p")))
    return per.select(
        *keys,
        F.when((F.col("_p") == 0) | (F.col("_p") == F.col("_n")), F.lit(undefined))
        .otherwise(value)
        .cast("double")
        .alias("roc_auc"),
    )


def pr_auc(long: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """Average precision: recall steps times the precision at each distinct score."""
    step = F.col("pos") / F.col("pos_all") * (F.col("tp") / F.col("pp"))
    return score_curve(long, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("pos_all") > 0, step)).alias("pr_auc")
    )


def recall_at_precision(long: DataFrame, precision: float, keys: Sequence[str] = ("tag",)) -> DataFrame:
    ok = F.col("tp") / F.col("pp") >= precision
    return score_curve(long, keys).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(ok, safe_divide(F.col("tp"), F.col("pos_all")))), F.lit(0.0)).alias(
            "recall"
        )
    )


def optimal_thresholds(long: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """Score with the best F1 per key, the lowest on ties; default F1 at 0.50.

    Both come out of the same curve: predictions at 0.50 are the curve point of the
    lowest score that is at least 0.50.
    """
    curve = score_curve(long, keys).withColumn(
        "f1", _f1(F.col("tp"), F.col("pp"), F.col("pos_all"))
    )
    at_default = F.col("score") >= k.DEFAULT_TAG_THRESHOLD
    best = F.max(F.struct(F.col("f1"), (-F.col("score")).alias("neg")))
    per = curve.groupBy(*keys).agg(
        F.max("pos_all").alias("positives"),
        best.alias("_best"),
        F.min_by(F.when(at_default, F.col("f1")), F.when(at_default, F.col("score"))).alias("_f1"),
    )
    found = F.col("positives") > 0
    raw = F.when(found, -F.col("_best.neg")).otherwise(F.lit(k.NO_POSITIVE_THRESHOLD))
    return per.select(
        *keys,
        "positives",
        F.coalesce("_f1", F.lit(0.0)).alias("f1_default"),
        raw.alias("threshold"),
        round_exact(raw, 4).alias("threshold_rounded"),
        F.when(found, F.col("_best.f1")).otherwise(F.lit(0.0)).alias("f1_best"),
    )


def thresholds_of_split(counted: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Best threshold per tag on one split of a table counted by (split, tag).

    The split is picked by a conditional aggregate: a filter would move below the count
    and make the planner score the rows a second time.
    """
    best = optimal_thresholds(counted, [split, "tag"])
    on = F.col(split) == value
    return best.groupBy("tag").agg(F.max(F.when(on, F.col("threshold"))).alias("threshold"))


def policy_table(long: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts of the static and the tuned policy in one pass over the rows."""
    both = with_thresholds(long, thresholds).withColumn(
        "_cuts",
        F.explode(
            F.array(
                F.struct(F.lit("static").alias("policy"), F.lit(k.DEFAULT_TAG_THRESHOLD).alias("cut")),
                F.struct(F.lit("tuned").alias("policy"), F.col("threshold").alias("cut")),
            )
        ),
    ).select("*", "_cuts.policy", "_cuts.cut")
    return confusion(both, [*keys, "policy"], F.col("score") >= F.col("cut"))


def threshold_gain(long: DataFrame, thresholds: DataFrame, split: str = "split") -> DataFrame:
    """Macro and micro F1 per split, static against tuned."""
    scores = macro_micro(policy_table(long, thresholds, [split, "tag"]), [split, "policy"])
    metrics = scores.select(
        split,
        "policy",
        F.inline(
            F.array(
                F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")),
                F.struct(F.lit("micro_f1").alias("metric"), F.col("micro_f1").alias("value")),
            )
        ),
    )
    wide = metrics.groupBy(split, "metric").pivot("policy", ["static", "tuned"]).agg(F.first("value"))
    return wide.withColumn("gain", F.col("tuned") - F.col("static"))


def tag_breakdown(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    counts = policy_table(long, thresholds, ["tag"])
    wide = counts.groupBy("tag").agg(
        F.max(F.col("tp") + F.col("fn")).alias("positives"),
        F.max(F.when(F.col("policy") == "static", F.col("f1"))).alias("f1_static"),
        F.max(F.when(F.col("policy") == "tuned", F.col("f1"))).alias("f1_tuned"),
    )
    return wide.withColumn("gain", F.col("f1_tuned") - F.col("f1_static"))


def weighted_loss(long: DataFrame, weights: Mapping[str, float], logit: Column) -> Column:
    """Weighted cross-entropy of each row, weight by tag."""
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    weight = F.coalesce(F.try_element_at(w, F.col("tag")), F.lit(1.0))
    return weighted_bce(logit, F.col("y").cast("double"), weight)


def evaluate(long: DataFrame, loss: Column, keys: Sequence[str], n_tags: int) -> DataFrame:
    """Rows, mean loss, perplexity, macro and micro F1, macro AUC per key, all from one
    counted table (``loss`` reads tag, y and score only).

    Every row appears once per tag, so rows are counted without a distinct.
    """
    keys = list(keys)
    counted = count_scores(long, [*keys, "tag"])
    sizes = counted.groupBy(*keys).agg(
        (F.sum(loss * F.col("w")) / F.sum("w")).alias("loss"),
        F.floor(F.sum("w") / n_tags).alias("rows"),
    )
    f1s = macro_micro(confusion(counted, [*keys, "tag"]), keys)
    auc = roc_auc(counted, [*keys, "tag"]).groupBy(*keys).agg(
        F.when(F.count("roc_auc") == F.count(F.lit(1)), F.avg("roc_auc")).alias("roc_auc")
    )
    out = reduce(lambda a, b: a.join(b, keys), [sizes, f1s, auc])
    return out.withColumn("perplexity", perplexity(F.col("loss")))


def compare_models(evaluated: DataFrame, base: str, tuned: str, metrics: Sequence[str]) -> DataFrame:
    """Per split and metric: base, tuned and their difference."""
    rows = evaluated.select(
        "split",
        "model",
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
            )
        ),
    )
    return rows.groupBy("split", "metric").agg(
        F.max(F.when(F.col("model") == base, F.col("value"))).alias("base"),
        F.max(F.when(F.col("model") == tuned, F.col("value"))).alias("tuned"),
    ).withColumn("difference", F.col("tuned") - F.col("base"))


def comparison_lines(compared: DataFrame) -> DataFrame:
    """Markdown rows of a base-against-tuned comparison with four digits."""
    sign = F.when(F.col("difference") < 0, "-").otherwise("+")
    return compared.select(
        "split",
        "metric",
        F.format_string(
            "| %s | %s | %s | %s | %s%s |",
            "split",
            "metric",
            fixed(F.col("base"), 4),
            fixed(F.col("tuned"), 4),
            sign,
            fixed(F.abs("difference"), 4),
        ).alias("line"),
    )


def promotion_check(
    slices: DataFrame, must_beat: Sequence[str], severe: Sequence[str]
) -> DataFrame:
    """Candidate against champion: better F1 on the named slices and no loss of recall
    on the severe tags.  ``slices`` has one row per (model, slice, tag)."""
    pair = slices.groupBy("slice", "tag").agg(
        *[
            F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
            for m in ("champion", "candidate")
            for c in ("f1", "recall")
        ]
    )
    named = F.col("slice").isin(list(must_beat))
    is_severe = F.col("tag").isin(list(severe))
    return pair.select(
        "slice",
        "tag",
        "champion_f1",
        "candidate_f1",
        "champion_recall",
        "candidate_recall",
        F.when(named, F.col("candidate_f1") > F.col("champion_f1")).otherwise(True).alias("f1_ok"),
        F.when(is_severe, F.col("candidate_recall") >= F.col("champion_recall"))
        .otherwise(True)
        .alias("recall_ok"),
    ).withColumn("promote", F.col("f1_ok") & F.col("recall_ok"))
