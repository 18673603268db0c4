"""Streams over several micro-batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from modspark import schemas
from modspark.functions import scores as S
from modspark.operators import windows
from modspark.session import scratch_path
from modspark.streaming import jobs


@pytest.fixture(scope="module")
def arrivals(spark):
    rng = random.Random(11)
    times = sorted(rng.randrange(400) for _ in range(600))
    rows = [(i, "hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}", t, t * 1000) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, user string, sec long, ms long")
    path = scratch_path(spark, "arrivals")
    for part in range(4):  # one file per micro-batch, in time order
        df.filter(F.col("id").between(part * 150, part * 150 + 149)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rate_limit_stream_equals_batch(spark, arrivals):
    df, path = arrivals
    out = jobs.rate_limit_stream(stream(spark, path, df.schema), "user", "sec", "id", 20, 60, idle_ms=None)
    got = jobs.run_to_table(spark, out, "rl").select("id", "prior", "allowed")
    assert same(got, windows.rate_limit(df, "user", "sec", "id", 20, 60).select("id", "prior", "allowed"))


def test_duplicates_stream_equals_batch(spark, arrivals):
    df, path = arrivals
    out = jobs.duplicates_stream(stream(spark, path, df.schema), ["user"], "ms", "id", 5000, idle_ms=None)
    want = windows.drop_near_duplicates(df, ["user"], "ms", "id", 5000)
    assert same(jobs.run_to_table(spark, out, "nd").select("id"), want.select("id"))


def test_history_stream_equals_batch_and_forgets_closed(spark, arrivals):
    df, path = arrivals
    turns = df.select(F.col("user").alias("conv"), F.col("id").alias("turn"), F.concat(F.lit("t"), "id").alias("text"))
    live = stream(spark, path, df.schema).select(
        F.col("user").alias("conv"), F.col("id").alias("turn"), F.concat(F.lit("t"), F.col("id")).alias("text"),
        (F.col("id") == 300).alias("closed"),
    )
    out = jobs.run_to_table(spark, jobs.history_stream(live, "conv", "turn", "text", idle_ms=None), "h")
    want = windows.history(turns, "conv", "turn", "text").select("conv", "turn", "history")
    assert same(out.select("conv", "turn", "history"), want)
    closed = jobs.run_to_table(spark, jobs.history_stream(live, "conv", "turn", "text", closed="closed", idle_ms=None), "hc")
    conv = closed.filter("turn = 300").first().conv
    after = closed.filter((F.col("conv") == conv) & (F.col("turn") > 300)).orderBy("turn").first()
    assert after.history == []


def test_watermark_duplicates_run(spark, arrivals):
    df, path = arrivals
    live = stream(spark, path, df.schema).withColumn("ts", F.timestamp_seconds("sec"))
    out = jobs.run_to_table(spark, jobs.duplicates_by_watermark(live, ["user"], "ts"), "wm")
    assert 0 < out.count() < df.count()


def test_feedback_triggers_and_status_over_batches(spark, arrivals):
    df, path = arrivals
    base = scratch_path(spark, "fb")
    jobs.feedback_triggers(stream(spark, path, df.schema), f"{base}/c", f"{base}/k", 250).awaitTermination()
    rows = spark.read.schema("batch_id long, n long, fires long, carry long").parquet(f"{base}/c").orderBy("batch_id").collect()
    assert [r.n for r in rows] == [150] * 4 and sum(r.fires for r in rows) == 2 and rows[-1].carry == 100
    up = stream(spark, path, df.schema).select("user", "id", F.col("sec").alias("status"))
    jobs.upsert_status(up, f"{base}/s", f"{base}/sk", "user", "id", ["status"]).awaitTermination()
    args = (up.schema, "user", "id", ["status"])
    want = df.groupBy("user").agg(F.max_by("sec", "id").alias("status"))
    assert same(jobs.latest_status(spark, f"{base}/s", *args).select("user", "status"), want)
    jobs.compact_status(spark, f"{base}/s", f"{base}/s2", *args)
    assert same(jobs.latest_status(spark, f"{base}/s2", *args).select("user", "status"), want)


def test_parameters_are_read_anew_per_batch(spark, arrivals):
    """A newer threshold version is used from the next micro-batch on."""
    df, path = arrivals
    params, out = scratch_path(spark, "params"), scratch_path(spark, "flags")
    spark.createDataFrame([("toxic", 0.5)], schemas.THRESHOLD).write.parquet(f"{params}/v=1")

    def apply(batch, batch_id):
        newest = batch.sparkSession.read.parquet(params)
        cut = newest.agg(F.max_by("threshold", "v")).scalar()
        flagged = batch.select("id", (F.lit(0.6) >= cut).alias("flagged"), F.lit(batch_id).alias("batch"))
        flagged.write.mode("append").parquet(out)
        if batch_id == 1:
            spark.createDataFrame([("toxic", 0.7)], schemas.THRESHOLD).write.parquet(f"{params}/v=2")

    live = stream(spark, path, df.schema).writeStream.foreachBatch(apply).trigger(availableNow=True)
    live.option("checkpointLocation", scratch_path(spark, "ck")).start().awaitTermination()
    got = {r.batch: r.f for r in spark.read.parquet(out).groupBy("batch").agg(F.max("flagged").alias("f")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_moderation_stream_and_delivery_by_channel(spark):
    path, base = scratch_path(spark, "msgs"), scratch_path(spark, "delivered")
    rows = [("1", "r1", "you idiot moron clown"), ("2", "r1", "hello there"), ("3", "r2", "नमस्ते é")]
    df = spark.createDataFrame(rows, "message_id string, channel_id string, text string")
    df.coalesce(1).write.parquet(path)
    moderated = jobs.moderation_stream(spark.readStream.schema(df.schema).parquet(path))
    jobs.write_delivered(
        moderated.select("message_id", "channel_id", "status", "detected_language"), f"{base}/o", f"{base}/k"
    ).awaitTermination()
    got = {r.message_id: (r.channel_id, r.detected_language) for r in spark.read.parquet(f"{base}/o").collect()}
    assert got == {"2": ("r1", "en"), "3": ("r2", "hi")}
    assert S.action is not None
