import pytest
from pyspark.sql import functions as F

from modspark.operators import feedback as FB
from modspark.operators import monitor, profile, tables
from modspark.plans import corpus


def test_keep_first_with_a_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"t{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r.id for r in tables.keep_first(df, F.col("text"), "id").collect()} == set(first.values())


def test_split_is_disjoint_covering_and_balanced(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b"))
    out = tables.stratified_split(df, ["a", "b"], 1, "id")
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    for r in out.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert abs(r.t - r.n / 10) <= 1


def test_rescue_keeps_all_rare_rows(spark):
    df = spark.range(200).select("id", (F.col("id") % 10 == 0).cast("int").alias("rare"))
    rare = F.col("rare") == 1
    for cap in (10, 60, 200, 500):
        out = tables.rescue_rare(df, cap, 42, "id", rare).collect()
        assert sum(r.rare for r in out) == 20
        assert len(out) == (200 if cap >= 200 else max(20, cap))


def test_insert_if_absent_takes_first_of_batch(spark):
    old = spark.createDataFrame([("a", 1)], "name string, id long")
    new = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6)], "name string, id long")
    got = sorted(tuple(r) for r in tables.insert_if_absent(old, new, "name", "id").collect())
    assert got == [("a", 1), ("b", 6)]


@pytest.mark.parametrize("pos,cap,want", [(1616, 25.0, 22.29), (494, 25.0, 25.0), (19467, 25.0, 1.0), (0, 25.0, 25.0), (1616, 20.0, 20.0)])
def test_class_weights(spark, pos, cap, want):
    df = spark.range(37638).select((F.col("id") < pos).cast("int").alias("t"))
    assert profile.class_weights(df, ["t"], cap).first().weight == want


def test_published_class_weights(spark):
    counts = [19467, 1616, 8461, 494, 17203, 2529]
    df = spark.range(37638).select(*[(F.col("id") < n).cast("int").alias(f"t{i}") for i, n in enumerate(counts)])
    got = {r.tag: r.weight for r in profile.class_weights(df, [f"t{i}" for i in range(6)]).collect()}
    assert [got[f"t{i}"] for i in range(6)] == [1.0, 22.29, 3.45, 25.0, 1.19, 13.88]


def test_length_profile_exact_and_approximate(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 2, 3, 10)], "text string")
    row = profile.length_profile(df, "text").filter("unit = 'characters'").first()
    assert (row.mean, row.median, row.p95, row.max) == (4.0, 2.5, pytest.approx(8.95), 10)
    assert profile.length_profile(df, "text", exact=False).count() == 2


def test_unify_rules(spark):
    binary = spark.createDataFrame([("x y", 1, None, 0), ("p q", 1, "English", 1), ("p q", 0, None, 2)], "text string, label int, lang string, row_idx long")
    classed = spark.createDataFrame(
        [(None, "raw one", "hof", "prfn", 0), (" p q ", "r", "NOT", "HATE", 1), ("z", "r", "NOT", "NONE", 2), (None, None, "NOT", "NONE", 3)],
        "`cleaned Tweets` string, rawtweets string, `binary class` string, `Context class` string, row_idx long",
    )
    got = {r.text: r for r in corpus.unify([corpus.from_binary(binary), corpus.from_classes(classed)]).collect()}
    assert set(got) == {"x y", "p q", "raw one"}
    assert (got["x y"].identity_hate, got["x y"].insult, got["x y"].source_language) == (1, 1, "hinglish")
    assert (got["p q"].identity_hate, got["p q"].toxic) == (0, 1)
    assert (got["raw one"].toxic, got["raw one"].obscene, got["raw one"].insult) == (1, 1, 1)


def test_feedback(spark):
    df = spark.createDataFrame([("m1", True, 1), ("m2", False, 2), ("m3", True, 3)], "message_id string, model_prediction_was_correct boolean, submitted_at int")
    row = FB.feedback_stats(df).first()
    assert tuple(row) == (3, 2, 1, 0.6667, 3, 497)
    assert FB.feedback_stats(df, F.lit(1)).first().since_last_retrain == 2
    assert tuple(FB.feedback_stats(df.limit(0)).first())[3:] == (0.0, 0, 500)
    done = spark.createDataFrame([("m2",)], "message_id string")
    assert FB.retrain_export(df, done).count() == 0 and FB.retrain_export(df, done, full=True).count() == 1
    fires = FB.retrain_batches(spark.range(1203), "id").filter("fires").select("id").collect()
    assert sorted(r.id for r in fires) == [499, 999]


def test_ops_metrics_with_frequencies(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:02", "a", 3.0), ("2024-01-01 00:00:03", "a", 3.0)], "ts string, g string, v double")
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    row = monitor.ops_metrics(log, "ts", "v", "1 minute", ["g"]).first()
    assert (row.requests, row.p50) == (3, 3.0)
    assert monitor.ops_metrics(log, "ts", "v", "1 minute", ["g"], exact=False).count() == 1


def test_disagreement(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "item int, label string")
    got = {r.item: (r.majority, r.disagreement) for r in FB.disagreement(df, "item", "label").collect()}
    assert got == {1: ("x", 0.333333), 2: ("z", 0.0)}
