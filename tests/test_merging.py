"""Status maps over streams and compactions, and parameters bound to micro-batches."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from modspark import schemas
from modspark.session import scratch_path
from modspark.sources import readers, sinks
from modspark.streaming import jobs, merging

SCHEMA = "id string, seq long, status string, entries map<string, int>"


def deliver(spark, maps, batches, checkpoint):
    path = scratch_path(spark, "updates")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    schema = spark.createDataFrame([], SCHEMA).schema
    maps.follow(jobs.stream_of(spark, path, schema, files=1), checkpoint).awaitTermination()


def fresh(spark):
    path = scratch_path(spark, "maps")
    return merging.StatusMaps(spark, path, spark.createDataFrame([], SCHEMA).schema, "id", "seq", "status", "entries"), path


def read(maps):
    return {r.id: (r.seq, r.status, r.entries) for r in maps.read().collect()}


def fold(rows):
    """Updates one after another, as a client would apply them."""
    out = {}
    for i, seq, status, entries in sorted(rows, key=lambda r: r[1]):
        old = out.get(i, (None, None, None))[2]
        merged = {**(old or {}), **entries} if entries else old
        out[i] = (seq, status, merged)
    return out


def test_batches_in_any_order_with_compactions_between_streams(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", "a", "b", "c"]), i, f"s{i}", {f"k{rng.randrange(6)}": i for _ in range(rng.randrange(3))} or None)
        for i in range(300)
    ]
    rng.shuffle(rows)
    maps, path = fresh(spark)
    deliver(spark, maps, [rows[:60], rows[60:120]], f"{path}/k1")
    maps.compact()
    assert read(maps) == fold(rows[:120])
    deliver(spark, maps, [rows[120:200]], f"{path}/k2")
    maps.compact()
    maps.compact()  # nothing new
    deliver(spark, maps, [rows[200:], rows[:50]], f"{path}/k3")
    assert read(maps) == fold(rows)
    base, deltas = maps._parts(maps._pointer())
    assert base.count() > 0 and {r.run for r in deltas.select("run").distinct().collect()} == {"c" + merging.hashlib.sha256(f"{path}/k3".encode()).hexdigest()[:16]}


def test_replayed_batches_ties_and_nulls(spark):
    maps, path = fresh(spark)
    rows = [("a", 1, "x", {"k": 1}), ("a", 1, "y", {"k": 2}), ("a", None, "z", {"k": 9, "only": 3}), (None, 5, "n", None), ("b", 2, None, {"k": None})]
    for run in ("k1", "k2"):  # the same updates again
        deliver(spark, maps, [rows, rows], f"{path}/{run}")
    want = {"a": (1, "y", {"k": 2, "only": 3}), None: (5, "n", None), "b": (2, None, {"k": None})}
    assert read(maps) == want
    maps.compact()
    assert read(maps) == want


def test_two_compactions_at_a_time(spark):
    maps, path = fresh(spark)
    deliver(spark, maps, [[("a", 1, "x", None)]], f"{path}/k")
    before = maps._pointer()
    maps.compact()
    maps._pointer = lambda: before
    with pytest.raises(AnalysisException):
        maps.compact()
    del maps._pointer
    assert read(maps) == {"a": (1, "x", None)}


def apply(batch, params):
    return batch.withColumn("cut", params.agg(F.max("threshold")).scalar())


def test_a_batch_keeps_the_run_of_its_first_attempt(spark):
    path, params, source = (scratch_path(spark, n) for n in ("swap", "params", "ids"))
    seen = []

    def feed(i):
        spark.createDataFrame([(i,)], "id long").coalesce(1).write.mode("append").parquet(source)
        live = jobs.stream_of(spark, source, spark.createDataFrame([], "id long").schema, files=1)
        merging.with_newest_params(live, params, schemas.THRESHOLD, apply, path, f"{path}/k").awaitTermination()
        seen.append({r.id: r.cut for r in spark.read.parquet(f"{path}/out").collect()})

    feed(0)  # no parameters yet
    sinks.write_params(spark.createDataFrame([("toxic", 0.5)], schemas.THRESHOLD), params, "run-9")
    feed(1)
    sinks.write_params(spark.createDataFrame([("toxic", 0.7)], schemas.THRESHOLD), params, "run-10")
    feed(2)
    assert seen == [{0: None}, {0: None, 1: 0.5}, {0: None, 1: 0.5, 2: 0.7}]
    assert [merging.bound_run(spark, path, i, params) for i in range(4)] == [None, "run-9", "run-10", "run-10"]


def test_newest_run(spark):
    path = scratch_path(spark, "runs")
    assert readers.newest_run(spark, path) is None and readers.params_of_run(spark, path, schemas.THRESHOLD, None).count() == 0
    for run, cut in (("2025-01-05", 0.2), ("2024-12-31", 0.9)):
        sinks.write_params(spark.createDataFrame([("toxic", cut)], schemas.THRESHOLD), path, run)
    assert readers.newest_run(spark, path) == "2025-01-05"
    assert [r.threshold for r in readers.params_of_run(spark, path, schemas.THRESHOLD, "2024-12-31").collect()] == [0.9]
