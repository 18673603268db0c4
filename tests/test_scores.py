import random

import pytest
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions import maths as M
from modspark.functions import scores as S
from modspark.operators import policy as P
from modspark.operators import scoring
from modspark.plans import moderation


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(
    "score,severity,toxic,status,rewrite",
    [
        (0.2999, "SAFE", False, "DELIVERED", False),
        (0.30, "LOW", True, "DELIVERED", False),
        (0.5499, "LOW", True, "DELIVERED", False),
        (0.55, "MEDIUM", True, "FLAGGED", True),
        (0.75, "HIGH", True, "BLOCKED", True),
    ],
)
def test_severity(spark, score, severity, toxic, status, rewrite):
    s = F.lit(score)
    got = one(spark, S.severity(s), S.is_toxic(s), S.action(S.severity(s)), S.needs_rewrite(S.is_toxic(s), S.severity(s)))
    assert got == (severity, toxic, status, rewrite)


@pytest.mark.parametrize(
    "scores,g,want",
    [
        ((0.9, 0.1, 0.2, 0.05, 0.6, 0.1), 0.20, (0.16, 0.1, 0.16, 0.05, 0.16, 0.1)),
        ((0.9, 0.1, 0.2, 0.05, 0.6, 0.1), 0.39, (0.312, 0.1, 0.2, 0.05, 0.312, 0.1)),
        ((0.2, 0.1, 0.1, 0.1, 0.1, 0.1), 0.70, (0.7, 0.1, 0.1, 0.1, 0.1, 0.1)),
        ((0.9, 0.1, 0.2, 0.05, 0.6, 0.1), 0.50, (0.9, 0.1, 0.2, 0.05, 0.6, 0.1)),
        ((0.9, 0.1, 0.2, 0.05, 0.6, 0.1), None, (0.9, 0.1, 0.2, 0.05, 0.6, 0.1)),
    ],
)
def test_gate(spark, scores, g, want):
    cats = one(spark, S.categories(S.gate(arr(*scores), F.lit(g).cast("double"))))[0]
    assert tuple(cats[t] for t in k.LABELS) == want


def test_gate_never_raises_in_its_first_branch(spark):
    rng = random.Random(1)
    rows = [([rng.random() for _ in range(6)], rng.random() * 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "s array<double>, g double").withColumn("o", S.gate(F.col("s"), F.col("g")))
    for r in df.collect():
        if r.g < 0.4 and max(r.s) >= 0.3:
            assert all(o <= s for o, s in zip(r.o, r.s))


def test_exact_rounding_follows_float_formatting(spark):
    xs = [i / 10000 * 100 for i in range(0, 10001, 3)] + [p / (p + 40) for p in range(500)] + [0.5, 1.5, 2.5, 0.125, 123456.25, 9876.35, 1e9 + 0.05]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    cols = [M.fixed(F.col("x"), d) for d in (0, 1, 2)] + [M.round_exact(F.col("x"), 2)]
    for x, *got in df.select("x", *cols).collect():
        assert got == [f"{x:.0f}", f"{x:.1f}", f"{x:.2f}", round(x, 2)]


def test_tag_lists(spark):
    cats = S.categories(arr(0.9, 0.1, 0.31, 0.05, 0.6, 0.31))
    assert one(spark, S.flagged_text(cats))[0] == "toxic: 0.90, insult: 0.60, obscene: 0.31, identity_hate: 0.31"
    s = arr(0.9, 0.1, 0.2, 0.05, 0.6, 0.1)
    assert one(spark, S.tag_triggers(s, {"toxic": 0.95}))[0] == ["INSULT (60.0%)"]
    assert one(spark, S.top_tag(arr(0.3, 0.9, 0.9, 0, 0, 0)))[0] == "severe_toxic"


def test_maths(spark):
    loss, big = one(spark, M.perplexity(F.lit(1.0)), M.perplexity(F.lit(20.0)))
    assert round(loss, 6) == 2.718282 and big == float("inf")
    assert one(spark, M.argmax(arr(1, 3, 3)), M.mean_cost(F.lit(7), F.lit(0)), M.safe_divide(F.lit(1), F.lit(0))) == (1, 7, 0.0)
    soft = one(spark, M.softmax(arr(1000, 1000)))[0]
    assert soft == [0.5, 0.5]
    bce = one(spark, M.weighted_bce(F.lit(0.0), F.lit(1.0), 2.0), M.weighted_bce(F.lit(-800.0), F.lit(0.0)))
    assert round(bce[0], 6) == 1.386294 and bce[1] == 0.0
    ts = F.lit("2024-03-01 00:00:01.987654").cast("timestamp_ntz")
    assert one(spark, M.epoch_seconds(ts), M.epoch_millis(ts)) == (1709251201, 1709251201987)


def test_quarantine_reports_every_rule(spark):
    df = spark.createDataFrame([(1, "ok"), (2, None), (3, ""), (4, "x" * 5001)], "id int, text string")
    good, bad = P.quarantine(df, P.request_rules())
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.violations for r in bad.collect()} == {2: ["text_missing"], 3: ["text_empty"], 4: ["text_too_long"]}


def test_large_term_tables_join_by_shuffle(spark, monkeypatch):
    """Past the size bound the salted shuffle join gives the same scores."""
    df = spark.createDataFrame([(i, "the idiot clown the " * (i % 3)) for i in range(50)], "id long, text string")
    terms = spark.createDataFrame(
        [("idiot", "toxic", 60), ("clown", "insult", 50), ("the", "obscene", 1)], "term string, tag string, weight int"
    )
    small = scoring.term_table_scorer(df, terms, "id", "text").collect()
    monkeypatch.setattr(scoring, "broadcast_if_small", lambda t: t)
    large = scoring.term_table_scorer(df, terms, "id", "text", salts=4).collect()
    assert sorted(small) == sorted(large)


def test_bypass_and_python_scorer_see_only_what_they_should(spark):
    df = spark.createDataFrame([(1, "idiot", False), (2, "idiot", True)], "message_id int, text string, skip boolean")

    def load():
        def model(texts):
            assert all(t == "idiot" for t in texts)
            return [[0.9] + [0.0] * 5 for _ in texts]

        return model

    for scorer in (None, scoring.plugin_scorer(load)):
        out = moderation.score_messages(df, scorer, F.col("skip"))
        got = {r.message_id: (r.severity, r.model_version) for r in out.collect()}
        assert got[2] == ("SAFE", k.BYPASS_VERSION) and got[1][0] != "SAFE"


def test_moderate_splits_rejected_and_invalid(spark):
    rows = [(i, "fool" if i % 2 else "fine", "u", 0, i) for i in range(25)] + [(99, "", "v", 0, 99)]
    df = spark.createDataFrame(rows, "message_id long, text string, user_id string, second long, arrival long")
    out = moderation.moderate(df, limits=(20, 60))
    assert out.results.count() == 20 and out.rejected.count() == 5
    assert [r.message_id for r in out.invalid.collect()] == [99]


def test_accept_and_offline(spark):
    m = spark.createDataFrame([("a", "bad", "FLAGGED", True, "MEDIUM"), ("b", "x", "DELIVERED", False, "SAFE")],
                              "message_id string, content string, status string, is_toxic boolean, severity string")
    acc = spark.createDataFrame([("a", "good")], "message_id string, suggestion string")
    got = {r.message_id: (r.content, r.status, r.is_toxic, r.severity) for r in P.accept_suggestions(m, acc).collect()}
    assert got == {"a": ("good", "DELIVERED", False, "SAFE"), "b": ("x", "DELIVERED", False, "SAFE")}
