"""Edits that are seen without the whole comparison, and what an operator leaves in the shared folder."""

import os
import random

from pyspark.sql import functions as F

from modspark.llm import lines
from modspark.llm.common import passing, stored
from modspark.session import shared_dir


def altered(rng, words, share):
    out = []
    for w in words:
        kind = rng.random() / share
        out += [w + rng.choice("xyz")] if kind < 0.4 else [] if kind < 0.7 else [w, rng.choice(words)] if kind < 1 else [w]
    return " ".join(out)


def test_near_is_never_said_of_lines_that_are_not(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(rng.choice([1, 5, 200]))]
        words = words * rng.choice([1, 1, 8])
        rows.append((" ".join(words), altered(rng, words, rng.choice([0.05, 0.3, 0.9]))))
    df = spark.createDataFrame(rows, "x string, y string")
    most = F.floor(0.2 * F.greatest(F.length("x"), F.length("y"))).cast("int")
    near = F.levenshtein("x", "y") <= most
    for seen in (lines._at_most, lines._at_most_evenly):
        got = df.select(near.alias("near"), seen(F.col("x"), F.col("y"), most).alias("seen")).collect()
        assert not any(r.seen and not r.near for r in got)
        if seen is lines._at_most:
            assert sum(r.seen for r in got) >= 0.8 * sum(r.near for r in got)


def test_long_near_lines_are_seen(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(" ".join(words), altered(rng, words, 0.02)), (" ".join(["osas"] * 3000), altered(rng, ["osas"] * 3000, 0.1))]
    df = spark.createDataFrame(rows, "x string, y string")
    most = F.lit(2400)
    assert [r[0] for r in df.select(lines._at_most(F.col("x"), F.col("y"), most) | lines._at_most_evenly(F.col("x"), F.col("y"), most)).collect()] == [True, True]


def test_lines_are_normalised_once(spark):
    docs = spark.createDataFrame([(1, "A 17  b\n\nc")], "doc_id long, text string")
    rows = lines.occurrences(lines._numbered(docs))
    assert [(r.line_no, r.norm) for r in rows.collect()] == [(0, "a 00 b"), (2, "c")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_only_what_is_read_later_stays(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    with passing(spark):
        rows = stored(spark.range(9), "gone")
        out = stored(rows, "stays", keep=True)
    left = {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x not in before}
    assert len(left) == 1 and left.pop().startswith("stays") and out.count() == 9
    docs = spark.createDataFrame([(1, "one line of words here"), (2, "one line of words here\nother")], "doc_id long, text string")
    got = lines.repeated_lines(docs)
    left = {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x not in before}
    assert sorted(x.split("-")[0] for x in left) == ["line_classes", "stays"]
    assert [sorted(tuple(r) for r in got.collect()) for _ in range(2)] == [[(1, 1, 0, []), (2, 2, 1, [0])]] * 2
