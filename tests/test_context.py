"""Scores of messages after their context, in batch and as a stream."""

import random

from pyspark.sql import functions as F

from modspark.lexicon import default_lexicon
from modspark.operators import scoring
from modspark.plans.moderation import moderate, moderate_conversations, score_messages
from modspark.session import scratch_path
from modspark.streaming import jobs

BAD = next(t for t, w in sorted(default_lexicon().items(), key=lambda x: -x[1][0]) if " " not in t and t.isalpha() and t.isascii())
SCHEMA = "conv long, turn long, text string"


def overall(df):
    return {(r.conv, r.turn): r.overall_score for r in df.collect()}


def test_context_moves_the_score_and_only_so_far(spark):
    rows = [(1, 0, f"you are {BAD} {BAD} {BAD}"), *((1, t, "well") for t in range(1, 7)), (2, 0, "well"), (3, 0, None), (3, 1, "well"), (4, 0, f"{BAD}")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = overall(moderate_conversations(df, "conv", "turn"))
    assert got[2, 0] == got[3, 1] == 0
    assert all(got[1, t] > 0 for t in range(1, 5)) and got[1, 5] == got[1, 6] == 0  # four turns
    assert got[1, 0] > got[1, 1]
    wide = overall(moderate_conversations(df, "conv", "turn", turns=5))
    assert wide[1, 5] == got[1, 1] and wide[1, 6] == 0
    alone = overall(score_messages(df, scoring.lexicon_scorer()))
    assert alone[4, 0] == got[4, 0] and alone[1, 1] == 0
    assert overall(score_messages(df, scoring.lexicon_context_scorer())) == alone  # no history


def test_a_model_gets_pairs(spark):
    def load():
        return lambda messages, contexts: [[min(1.0, len(m) / 100), 1.0 if c else 0.0, 0, 0, 0, 0] for m, c in zip(messages, contexts, strict=True)]

    df = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abc")], SCHEMA)
    got = overall(moderate_conversations(df, "conv", "turn", scoring.plugin_context_scorer(load)))
    assert got == {(1, 0): 0.02, (1, 1): 1.0}


def test_end_to_end_takes_history(spark):
    df = spark.createDataFrame([(1, "well", [f"{BAD} {BAD}"]), (2, "well", None), (3, "well", [])], "message_id long, text string, before array<string>")
    out = moderate(df, scoring.lexicon_context_scorer(), history=F.col("before")).results
    got = {r.message_id: r.overall_score for r in out.collect()}
    assert got[1] > 0 and got[2] == got[3] == 0


def test_stream_equals_batch_over_many_batches(spark):
    rng = random.Random(6)
    words = ["fine", "well", BAD, f"{BAD} {BAD}", "so", None]
    rows = [(c, t, rng.choice(words)) for c in [0, 1, 2, 3, None] for t in range(40)]
    path = scratch_path(spark, "talk")
    for part in range(4):  # a file is a micro-batch
        own = [r for r in rows if r[1] // 10 == part]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_of(spark, path, spark.createDataFrame([], SCHEMA).schema, files=1)
    got = jobs.run_to_table(spark, jobs.conversation_stream(stream, "conv", "turn", idle_ms=None).select("conv", "turn", "overall_score"), "talk_scores")
    want = moderate_conversations(spark.createDataFrame(rows, SCHEMA), "conv", "turn")
    key = lambda r: (r[0] is None, r)
    a, b = (sorted(((r.conv if r.conv is not None else -1, r.turn, r.overall_score) for r in x.collect()), key=key) for x in (got, want))
    named = [r for r in b if r[0] != -1]
    assert [r for r in a if r[0] != -1] == named and len(a) == len(rows)


def test_rows_without_a_second_are_not_limited_in_the_stream(spark):
    rows = [(1, None, 1), (1, 5, 2), (1, 6, 3), (1, None, 4), (2, None, 5), (None, 5, 6)]
    path = scratch_path(spark, "limits")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "u long, s long, e long").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_of(spark, path, spark.createDataFrame([], "u long, s long, e long").schema, files=1)
    got = jobs.run_to_table(spark, jobs.rate_limit_stream(stream, "u", "s", "e", 1, 60, idle_ms=None), "limited").collect()
    assert {r.e: (r.s, r.prior, r.allowed) for r in got} == {1: (None, 0, True), 2: (5, 0, True), 3: (6, 1, False), 4: (None, 0, True), 5: (None, 0, True), 6: (5, 0, True)}
