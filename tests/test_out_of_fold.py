"""Rows are scored by models that did not see their fold, and learnable labels are told apart."""

import random

from pyspark.sql import functions as F

from modspark.operators import evaluate as E
from modspark.operators import tables, training


def corpus(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        rows.append((i, " ".join(rng.choices(words, k=12) + (["signal"] if y else ["noise"])), y))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_scores_tell_a_learnable_label(spark):
    folds = training.featurise(tables.kfold(corpus(spark), 3, 42, "doc_id"), "text")
    out = training.out_of_fold(folds, 3, ["toxic"]).withColumn("score", F.col("scores")[0])
    long = out.select("doc_id", F.lit("t").alias("tag"), F.col("toxic").alias("y"), "score").cache()
    assert long.count() == long.select("doc_id").distinct().count() == 240
    assert E.roc_auc(long).first().roc_auc > 0.9  # 0.949: scores of three models in one ranking


def test_models_do_not_see_their_fold(spark):
    """A word that only one fold has cannot move the scores of that fold."""
    folds = tables.kfold(corpus(spark), 3, 42, "doc_id")
    marked = folds.withColumn("text", F.when((F.col("fold") == 0) & (F.col("toxic") == 1), F.concat("text", F.lit(" onlyhere"))).otherwise(F.col("text")))

    def first_fold(df):
        out = training.out_of_fold(training.featurise(df, "text"), 3, ["toxic"])
        return {r.doc_id: r.s for r in out.where("fold = 0").select("doc_id", F.round(F.col("scores")[0], 9).alias("s")).collect()}

    assert first_fold(marked) == first_fold(folds)
