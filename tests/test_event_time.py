"""Rate limit and duplicates by event time: out of order over micro-batches, late rows, null columns, empty state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from modspark.operators import windows
from modspark.session import scratch_path
from modspark.streaming import event_time, jobs

START = datetime.datetime(2025, 1, 1)
SCHEMA = "id long, user string, at timestamp"
END = START + datetime.timedelta(days=2)


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


def run(spark, batches, make):
    """Rows of the stream over the batches (a file each), and what its state holds at the end."""
    path, base = scratch_path(spark, "timed"), scratch_path(spark, "timed-out")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_of(spark, path, spark.createDataFrame([], SCHEMA).schema, files=1)
    out = make(stream)
    writer = out.writeStream.option("checkpointLocation", f"{base}/k").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/o").start().awaitTermination()
    held = spark.read.format("statestore").load(f"{base}/k")
    return spark.read.schema(out.schema).parquet(f"{base}/o"), held.count()


@pytest.fixture(scope="module")
def dealt():
    """Rows up to 5 s out of order over four files, with one dominant user; then one that moves the clock."""
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.5 else f"u{rng.randrange(5)}", at(rng.randrange(300_000))) for i in range(600)]
    files = [[] for _ in range(4)]
    for row in rows:
        lag = (row[2] - START).total_seconds() + rng.random() * 5
        files[min(3, int(lag // 75))].append(row)
    return rows, [*files, [(-1, None, END)]]


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("id", "user", F.unix_seconds("at").alias("sec"), F.unix_millis("at").alias("ms"))


def test_rate_limit_equals_the_batch_form_and_leaves_no_state(spark, dealt):
    rows, files = dealt
    got, held = run(spark, files, lambda s: event_time.rate_limit_by_time(s, "user", "at", "id", 20, 60, 6000))
    got = {r.id: (r.prior, r.allowed == 1, r.status) for r in got.collect()}
    want = {r.id: (r.prior, r.allowed, "decided") for r in windows.rate_limit(batch(spark, rows), "user", "sec", "id", 20, 60).collect()}
    assert got.pop(-1) == (0, True, "decided") and got == want and held == 0


def test_duplicates_equal_the_batch_form_and_leave_no_state(spark, dealt):
    rows, files = dealt
    files = [*files[:-1], [(-1, "z", END)], [(-2, "z", END + datetime.timedelta(days=1))]]
    got, held = run(spark, files, lambda s: event_time.duplicates_by_time(s, ["user"], "at", "id", 5000, 6000))
    kept = {r.id for r in got.where("kept = 1 and id >= 0").collect()}
    want = windows.drop_near_duplicates(batch(spark, rows), ["user"], "ms", "id", 5000)
    assert kept == {r.id for r in want.collect()} and got.where("id >= 0").count() == len(rows)
    assert held == 1  # what moved the clock itself


def test_late_rows_and_rows_without_a_time_go_out_with_a_reason(spark):
    files = [
        [(1, "a", at(0)), (2, "a", None), (3, None, None), (4, None, at(0))],
        [(5, "a", at(60_000)), (6, "a", at(50_000))],
        [(7, "a", at(1000)), (8, "a", at(60_000)), (9, "a", at(55_000))],  # closed: before 50 s
        [(-1, None, END)],
    ]
    got, held = run(spark, files, lambda s: event_time.rate_limit_by_time(s, "user", "at", "id", 2, 30, 10_000))
    got = {r.id: (r.prior, r.allowed, r.status) for r in got.collect()}
    assert got == {
        1: (0, 1, "decided"), 2: (None, None, "no_time"), 3: (None, None, "no_time"), 4: (0, 1, "decided"), 5: (2, 0, "decided"),
        6: (0, 1, "decided"), 7: (None, None, "late"), 8: (3, 0, "decided"), 9: (1, 1, "decided"), -1: (0, 1, "decided"),
    }
    assert held == 0


def test_no_rows(spark):
    got, held = run(spark, [[]], lambda s: event_time.rate_limit_by_time(s, "user", "at", "id"))
    assert got.count() == 0 and held == 0


def test_many_keys_share_calls_and_keep_their_own_memory(spark):
    odd = [None, "", '"{\\', "नमस्ते\n"]
    rows = [(i, odd[i] if i < len(odd) else f"u{i}", at(i % 7)) for i in range(2500)]
    more = [(10_000 + i, u, at(3000)) for i, u, _ in rows]
    out, held = run(spark, [rows, more], lambda s: event_time.duplicates_by_time(s, ["user"], "at", "id", 5000, 6000))
    assert out.count() == 0 and 0 < held <= event_time.BUCKETS  # all rows wait, in fewer states than keys
    out, held = run(spark, [rows, more, [(-1, "z", END)], [(-2, "z", END + datetime.timedelta(days=1))]], lambda s: event_time.duplicates_by_time(s, ["user"], "at", "id", 5000, 6000))
    got = {(r.id, r.user): r.kept for r in out.where("id >= 0").collect()}
    assert got == {(i, u): int(i < 10_000) for i, u, _ in rows + more} and held == 1
