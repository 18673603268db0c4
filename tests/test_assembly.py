"""Chunks of messages put in order as a stream."""

import datetime
import random

from modspark.session import scratch_path
from modspark.streaming import jobs

SCHEMA = "id string, seq long, chunk string, last boolean, at timestamp"
START = datetime.datetime(2025, 1, 1)


def run(spark, batches, **options):
    path = scratch_path(spark, "chunks")
    for rows in batches:  # a file is a micro-batch
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_of(spark, path, spark.createDataFrame([], SCHEMA).schema, files=1)
    out = jobs.run_to_table(spark, jobs.assembled_stream(stream, "id", "seq", "chunk", "last", **options), "assembled")
    return [tuple(r) for r in out.collect()]


def test_chunks_over_many_batches_in_any_order(spark):
    rng = random.Random(1)
    texts = {f"m{i}": [f"w{i}.{j} " for j in range(rng.randint(1, 30))] for i in range(12)}
    rows = [(m, j, t, j == len(x) - 1, START) for m, x in texts.items() for j, t in enumerate(x)]
    rows += rng.sample(rows, 40)  # some come twice
    rng.shuffle(rows)
    got = run(spark, [rows[i::5] for i in range(5)])
    for m, x in texts.items():
        own = sorted(r for r in got if r[0] == m)
        assert "".join(r[3] for r in own) == "".join(x) and sum(r[2] for r in own) == len(x)
        assert [r[1] for r in own] == [sum(r[2] for r in own[:i]) for i in range(len(own))]
        assert [r[4] for r in own] == [jobs.PART] * (len(own) - 1) + [jobs.DONE]


def test_nothing_goes_out_over_a_gap(spark):
    got = run(spark, [[("a", 2, "c", True, START)], [("a", 0, "a", False, START)], [("a", None, "x", None, None), ("b", 0, None, True, None)]])
    assert sorted(got, key=repr) == sorted([("a", 0, 1, "a", jobs.PART), ("a", None, 1, "x", jobs.NO_PLACE), ("b", 0, 1, "", jobs.DONE)], key=repr)


def test_a_message_that_stops_times_out_with_what_it_has(spark):
    late = START + datetime.timedelta(minutes=10)
    batches = [
        [("a", 0, "a", False, START), ("a", 2, "c", False, START), ("a", 3, "d", True, START), ("b", 0, "b", True, START)],
        [("z", 0, "z", False, late)],
        [("z", 1, "y", False, late + datetime.timedelta(seconds=1))],
    ]
    got = run(spark, batches, time="at", delay="5 seconds", wait_ms=60_000)
    assert ("a", 0, 1, "a", jobs.PART) in got and ("a", 2, 2, "cd", jobs.TIMED_OUT) in got
    assert [r for r in got if r[0] == "b"] == [("b", 0, 1, "b", jobs.DONE)]
    assert "".join(r[3] for r in sorted(got) if r[0] == "z") == "zy"


def test_messages_share_state_rows(spark):
    """Many messages, keys of any type and null, times out for some: rows as message by message, one state row a bucket."""
    rng = random.Random(3)
    late = START + datetime.timedelta(minutes=10)
    rows, want = [], set()
    for i in range(1500):
        name, n = None if i == 7 else f"m\n{i}", rng.randint(1, 6)
        missing = i % 5 == 0 and n > 2
        rows += [(name, j, f"w{i}.{j} ", j == n - 1, START) for j in range(n) if not (missing and j == 1)]
        want.add((name, n - missing, jobs.TIMED_OUT if missing else jobs.DONE))
    rng.shuffle(rows)
    path, base = scratch_path(spark, "many"), scratch_path(spark, "many-out")
    for batch in (rows[::2], rows[1::2], [("z", 0, "z", True, late)], [("z", 1, "y", True, late + datetime.timedelta(seconds=1))]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_of(spark, path, spark.createDataFrame([], SCHEMA).schema, files=1)
    for name, options in (("timed", {"time": "at", "delay": "5 seconds", "wait_ms": 60_000}), ("kept", {})):
        out = jobs.assembled_stream(stream, "id", "seq", "chunk", "last", **options)
        writer = out.writeStream.option("checkpointLocation", f"{base}/{name}-k").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{base}/{name}").start().awaitTermination()
        got = spark.read.schema(out.schema).parquet(f"{base}/{name}").collect()
        by = {}
        for r in sorted(got, key=lambda r: r.start):
            if r.id != "z":
                by.setdefault(r.id, []).append(r)
        ended = {(m, sum(r.chunks for r in own), own[-1].status) for m, own in by.items()}
        if options:
            assert ended == want
        else:
            assert {x for x in ended if x[2] == jobs.DONE} == {x for x in want if x[2] == jobs.DONE}
        state = spark.read.format("statestore").load(f"{base}/{name}-k").count()
        assert state <= (1 if options else jobs.BUCKETS)
