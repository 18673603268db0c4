"""Trained scorers on MLlib: one weighted logistic regression per tag, out-of-fold
tables and the stacked decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions.maths import argmax
from modspark.operators.tables import stack_features
from modspark.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder: a fit passes over its rows several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def featurise(df: DataFrame, text: str, buckets: int = 1 << 14) -> DataFrame:
    """Adds ``_features``: hashed counts of whole-text tokens and token pairs.

    Every stage is row-local; nothing is fitted.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_tok", pattern="[^\\p{L}\\p{N}_]+")
    pairs = NGram(n=2, inputCol="_tok", outputCol="_pairs")
    both = pairs.transform(words.transform(df)).withColumn("_terms", F.concat("_tok", "_pairs"))
    hashed = HashingTF(inputCol="_terms", outputCol="_features", numFeatures=buckets)
    return hashed.transform(both).drop("_tok", "_pairs", "_terms")


def train_tags(
    train: DataFrame,
    tags: Sequence[str],
    weights: Mapping[str, float] | None = None,
    features: str = "_features",
    iterations: int = 20,
    regularisation: float = 0.01,
) -> dict[str, object]:
    """tag -> fitted model; positives of a tag weigh ``weights[tag]``."""
    models = {}
    for tag in tags:
        w = float((weights or {}).get(tag, 1.0))
        data = train.withColumn("_w", F.when(F.col(tag) == 1, F.lit(w)).otherwise(F.lit(1.0)))
        models[tag] = LogisticRegression(
            featuresCol=features,
            labelCol=tag,
            weightCol="_w",
            maxIter=iterations,
            regParam=regularisation,
            probabilityCol="_prob",
            rawPredictionCol="_raw",
            predictionCol="_pred",
        ).fit(data)
    return models


def score_tags(df: DataFrame, models: Mapping[str, object], out: str = "scores") -> DataFrame:
    """Scores of every tag as one array; the models run in sequence on the same rows."""
    scored = df
    for tag, model in models.items():
        scored = (
            model.transform(scored)
            .withColumn(f"_s_{tag}", vector_to_array("_prob")[1])
            .drop("_prob", "_raw", "_pred")
        )
    cols = [f"_s_{t}" for t in models]
    return scored.withColumn(out, F.array(*cols)).drop(*cols)


def out_of_fold(
    df: DataFrame, folds: int, tags: Sequence[str], weights: Mapping[str, float] | None = None, fold: str = "fold"
) -> DataFrame:
    """Every row scored by models that did not see its fold. Features are made once and stored."""
    df = stored(df, "features")
    parts = []
    for i in range(folds):
        models = train_tags(df.filter(F.col(fold) != i), tags, weights)
        parts.append(score_tags(df.filter(F.col(fold) == i), models))
    return reduce(lambda a, b: a.unionByName(b), parts)


def model_outputs(toxic_logit: Column, tag_logits: Column, severity_logits: Column) -> Column:
    """sigmoid(1), sigmoid(6), softmax(4) as one 11-element array."""
    from modspark.functions.maths import sigmoid, softmax

    return F.concat(
        F.array(sigmoid(toxic_logit)),
        F.transform(tag_logits, lambda x: sigmoid(x)),
        softmax(severity_logits),
    )


def fit_meta(stacked: DataFrame, toxic: str, severity: str, iterations: int = 20) -> tuple[object, object]:
    """Meta models over stacked features: binary toxic head and severity head."""
    data = stored(stacked, "stacked").withColumn("_v", array_to_vector("features"))
    common = dict(
        featuresCol="_v", maxIter=iterations, regParam=0.01, predictionCol="_pred", rawPredictionCol="_raw"
    )
    head = LogisticRegression(labelCol=toxic, probabilityCol="_p", **common).fit(data)
    levels = LogisticRegression(
        labelCol=severity, probabilityCol="_p", family="multinomial", **common
    ).fit(data)
    return head, levels


def decide(stacked: DataFrame, meta: tuple[object, object]) -> DataFrame:
    """Toxic above one half, severity by the largest level."""
    head, levels = meta
    data = stacked.withColumn("_v", array_to_vector("features"))
    first = (
        head.transform(data)
        .withColumn("toxic_probability", vector_to_array("_p")[1])
        .drop("_p", "_raw", "_pred")
    )
    both = levels.transform(first).withColumn("severity_level", argmax(vector_to_array("_p")))
    return both.withColumn("is_toxic", F.col("toxic_probability") > 0.5).drop(
        "_p", "_raw", "_pred", "_v"
    )


__all__ = [
    "decide",
    "featurise",
    "fit_meta",
    "model_outputs",
    "out_of_fold",
    "score_tags",
    "stack_features",
    "stored",
    "train_tags",
]
