"""Ordered operators against brute force, with one key holding most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from modspark.operators import ordinal as O
from modspark.operators import tables, windows


def skewed(n, seed, span):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.6 else f"u{rng.randrange(5)}", rng.randrange(span)) for i in range(n)]


def brute_rate(rows, limit, window):
    out, log = {}, {}
    for i, user, sec in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [s for s in log.get(user, []) if s > sec - window]
        out[i] = (len(live), len(live) < limit)
        log[user] = live + [sec]
    return out


def test_rate_limit_golden(spark):
    df = spark.createDataFrame([(i, "u", s) for i, s in enumerate([0, 10, 20, 61, 130])], "id long, user string, sec long")
    got = windows.rate_limit(df, "user", "sec", "id", 2, 60).orderBy("sec").collect()
    assert [(r.prior, r.allowed) for r in got] == [(0, True), (1, True), (2, False), (2, False), (0, True)]


@pytest.mark.parametrize("span", [30, 500, 5000])
def test_rate_limit_brute(spark, monkeypatch, span):
    monkeypatch.setattr(windows, "TIE_BLOCK", 64)  # several tie blocks inside one second
    rows = skewed(800, span, span)
    df = spark.createDataFrame(rows, "id long, user string, sec long")
    got = {r.id: (r.prior, r.allowed) for r in windows.rate_limit(df, "user", "sec", "id", 20, 60).collect()}
    assert got == brute_rate(rows, 20, 60)


@pytest.mark.parametrize("block", [1, 3, 7, 1024])
def test_history_blocks(spark, block):
    rng = random.Random(block)
    turns = [("hot", t) for t in range(40)] + [("gap", t) for t in sorted(rng.sample(range(200), 15))] + [("one", 0)]
    df = spark.createDataFrame([(c, t, f"{c}{t}") for c, t in turns], "conv string, turn long, text string")
    got = {(r.conv, r.turn): r.history for r in windows.history(df, "conv", "turn", "text", 5, block).collect()}
    for conv, turn in turns:
        before = [f"{c}{t}" for c, t in turns if c == conv and t < turn]
        assert got[(conv, turn)] == before[-5:]


def test_context(spark):
    df = spark.createDataFrame([(["m2", "m3", "m4", "m5", "m6"], "m7"), ([], "m1")], "h array<string>, m string")
    got = df.select(windows.context_string(F.col("h")), windows.segments(F.col("h"), F.col("m"))).collect()
    assert got[0][0] == "m3 m4 m5 m6" and tuple(got[0][1]) == ("m3 m4 m5 m6", "m7")
    assert got[1][0] is None and tuple(got[1][1]) == ("m1", None)


def brute_kept(rows, gap):
    kept, last = set(), {}
    for i, key, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or ms - last[key] >= gap:
            last[key] = ms
            kept.add(i)
    return kept


def test_near_duplicate_golden(spark):
    for times, want in (([0, 4000, 8000], [0, 8000]), ([0, 5000], [0, 5000])):
        df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "id long, key string, ms long")
        got = windows.drop_near_duplicates(df, ["key"], "ms", "id").orderBy("ms").collect()
        assert [r.ms for r in got] == want


@pytest.mark.parametrize("gap,block,span", [(50, 50, 4000), (7, 100, 3000), (300, 300, 5000)])
def test_near_duplicates_brute(spark, gap, block, span):
    """The dense hot key links many blocks (flood path), the others stay short."""
    rows = skewed(700, gap, span)
    df = spark.createDataFrame(rows, "id long, key string, ms long")
    kept = windows.drop_near_duplicates(df, ["key"], "ms", "id", gap, block)
    assert {r.id for r in kept.collect()} == brute_kept(rows, gap)


def test_ordinal_and_smallest_match_a_plain_window(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, key string")
    h = O.seeded_hash(3, F.col("id"))
    import hashlib

    order = sorted(range(1000), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    got = {r.id: r.ordinal for r in O.ordinal(df, h, O.hash_bucket(h)).collect()}
    assert got == {i: p for p, i in enumerate(order)}
    by_key = {r.id: r.ordinal for r in O.ordinal(df, h, O.hash_bucket(h), ["key"]).collect()}
    hot = [i for i in order if i % 3]
    assert all(by_key[i] == p for p, i in enumerate(hot))
    assert {r.id for r in O.smallest(df, 37, h, O.hash_bucket(h)).collect()} == set(order[:37])
    assert O.smallest(df, 5000, h, O.hash_bucket(h)).count() == 1000
    assert O.smallest(df, 0, h, O.hash_bucket(h)).count() == 0


def test_ordinal_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, key string")
    h = O.seeded_hash(1, F.col("id"))
    assert O.ordinal(df, h, O.hash_bucket(h), ["key"]).count() == 3


def test_range_bucket_is_monotone(spark):
    df = spark.createDataFrame([(i * 37 - 500,) for i in range(300)], "v long")
    got = df.select("v", O.range_bucket(df, F.col("v"), 16).alias("b")).orderBy("v").collect()
    buckets = [r.b for r in got]
    assert buckets == sorted(buckets) and buckets[0] == 0 and buckets[-1] <= 16


def test_latest_and_chunks(spark):
    up = spark.createDataFrame(
        [(1, 1, "FLAGGED", {"a": "1", "b": "1"}), (1, 2, "DELIVERED", {"b": "2"})],
        "id int, seq int, status string, m map<string,string>",
    )
    row = tables.latest_by_id(up, "id", "seq", "status", "m").first()
    assert (row.status, row.m) == ("DELIVERED", {"a": "1", "b": "2"})
    chunks = spark.createDataFrame([(1, 1, "b "), (1, 0, "a "), (1, 2, "c")], "id int, seq int, chunk string")
    assert tables.assemble_chunks(chunks, "id", "seq", "chunk").first().text == "a b c"


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", None)], "id long, key string, ms long")
    assert windows.drop_near_duplicates(df.filter("id < 3"), ["key"], "ms", "id").count() == 1
    got = {r.id: r.allowed for r in windows.rate_limit(df, "key", "ms", "id", 1, 60).collect()}
    assert got == {1: True, 2: True, 3: True}
