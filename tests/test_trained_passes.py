"""Fits and scores read stored features: what makes them runs once for each row."""

import pytest
from pyspark.sql import functions as F

from modspark.operators import training

ROWS = [(i, i % 3, i % 2, "bad words here" if i % 2 else "good words there") for i in range(60)]


@pytest.fixture()
def counted(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(text):
        seen.add(1)
        return text

    df = spark.createDataFrame(ROWS, "doc_id long, fold int, toxic int, text string")
    return seen, df.withColumn("text", once.asNondeterministic()("text"))


def test_out_of_fold_makes_features_once(counted):
    seen, df = counted
    out = training.out_of_fold(training.featurise(df, "text", 64).drop("text"), 3, ["toxic"], {"toxic": 6.0})
    rows = out.select("doc_id", "fold", "toxic", F.col("scores")[0].alias("s")).collect()
    assert seen.value == len(ROWS)
    assert sorted((r.doc_id, r.fold, r.toxic) for r in rows) == [r[:3] for r in ROWS]
    assert all((r.s > 0.5) == (r.toxic == 1) for r in rows)


def test_meta_models_read_stacked_rows_once(counted):
    seen, df = counted
    f = F.array(F.col("toxic") + 0.1, F.length("text") * 0.1)
    training.fit_meta(df.select("doc_id", "toxic", F.col("fold").alias("level"), f.alias("features")), "toxic", "level")
    assert seen.value == len(ROWS)
