import random

import pytest
from pyspark.sql import functions as F

from modspark.operators import evaluate as E


def long_table(spark, rows):
    return spark.createDataFrame(rows, "tag string, y int, score double")


GOLDEN = [("t", y, s) for y, s in zip([1, 1, 0, 0], [0.9, 0.4, 0.6, 0.1])]


def test_threshold_golden(spark):
    row = E.optimal_thresholds(long_table(spark, GOLDEN)).first()
    assert (row.threshold, round(row.f1_best, 4), row.f1_default) == (0.4, 0.8, 0.5)
    none = E.optimal_thresholds(long_table(spark, [("n", 0, 0.3), ("n", 0, 0.7)])).first()
    assert (none.threshold, none.f1_best) == (0.15, 0.0)


def test_auc_golden_and_undefined(spark):
    assert E.roc_auc(long_table(spark, GOLDEN)).first().roc_auc == 0.75
    one_class = long_table(spark, [("n", 0, 0.3), ("n", 0, 0.7)])
    assert E.roc_auc(one_class).first().roc_auc is None
    assert E.roc_auc(one_class, undefined=0.5).first().roc_auc == 0.5


def test_curves_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("t", int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    df = long_table(spark, rows)
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df).first().roc_auc == pytest.approx(auc)
    # The counted table gives the same answers as the rows.
    counted = E.count_scores(df, ["tag"])
    assert E.roc_auc(counted).first() == E.roc_auc(df).first()
    assert E.confusion(counted).first() == E.confusion(df).first()
    best = max(
        (2 * sum(y for _, y, s in rows if s >= c) / (sum(s >= c for _, _, s in rows) + len(pos)), -c)
        for c in {s for _, _, s in rows}
    )
    row = E.optimal_thresholds(df).first()
    assert row.threshold == -best[1] and row.f1_best == pytest.approx(best[0])
    ap, tp, pp = 0.0, 0, 0
    for c in sorted({s for _, _, s in rows}, reverse=True):
        at = sum(y for _, y, s in rows if s == c)
        tp, pp = tp + at, pp + sum(s == c for _, _, s in rows)
        ap += at / len(pos) * tp / pp
    assert E.pr_auc(df).first().pr_auc == pytest.approx(ap)


def test_evaluate_and_compare(spark):
    rows = [(i, "val", t, int(i % 2 == 0), 0.9 if i % 2 == 0 else 0.2) for i in range(10) for t in ("a", "b")]
    long = spark.createDataFrame(rows, "row_id long, split string, tag string, y int, score double")
    out = E.evaluate(long, E.weighted_loss(None, {"a": 2.0}, F.col("score")), ["split"], 2).first()
    assert (out.rows, out.macro_f1, out.micro_f1, out.roc_auc) == (10, 1.0, 1.0, 1.0)
    two = spark.createDataFrame([("val", "x", 0.5), ("val", "y", 0.75)], "split string, model string, f double")
    assert E.compare_models(two, "x", "y", ["f"]).first().difference == 0.25


def test_slices_in_one_exchange_equal_slices_one_by_one(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "hi", None]), rng.random() < 0.3, rng.choice("ab"), rng.randrange(2), rng.random()) for _ in range(500)]
    long = spark.createDataFrame(rows, "lang string, hard boolean, tag string, y int, score double")
    out = E.slice_confusion(long, ["lang", "hard"])
    got = {(r.kind, r.slice, r.tag): (r.tp, r.fp, r.fn, r.tn, r.f1) for r in out.collect()}
    want = {}
    for kind in ("lang", "hard"):
        for r in E.confusion(long.withColumn(kind, F.col(kind).cast("string")), [kind, "tag"]).collect():
            want[kind, r[kind], r.tag] = (r.tp, r.fp, r.fn, r.tn, r.f1)
    assert got == want and ("lang", None, "a") in got
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert E.slice_confusion(long.limit(0), ["lang", "hard"]).count() == 0
