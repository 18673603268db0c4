"""Keys of lines: which pairs share one, whatever else there is."""

import random

import pytest
from pyspark.sql import functions as F

from modspark.llm import lines


def sharing(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    both = F.arrays_overlap(lines.line_keys(F.col("a")), lines.line_keys(F.col("b")))
    return {r.i: r.shared for r in df.select("i", both.alias("shared")).collect()}


def word(rng, low=3, high=9):
    return "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(low, high)))


def test_short_lines_one_character_apart(spark):
    rng = random.Random(1)
    pairs = []
    for n in range(5, 34):
        a = "".join(rng.choice("abc de") for _ in range(n))
        at = rng.randrange(n)
        pairs += [(a, a[:at] + "x" + a[at + 1 :]), (a, a[:at] + a[at + 1 :])]
    assert all(sharing(spark, pairs).values())


@pytest.mark.parametrize("n", [5, 7, 9])
def test_few_words_one_word_apart(spark, n):
    rng = random.Random(n)
    pairs = []
    for _ in range(40):
        a = [word(rng, 8, 12) for _ in range(n)]
        at = rng.randrange(n)
        pairs += [(" ".join(a), " ".join([*a[:at], word(rng), *a[at + 1 :]])), (" ".join(a), " ".join(a[:at] + a[at + 1 :]))]
    assert all(sharing(spark, pairs).values())


@pytest.mark.parametrize("n, least", [(10, 0.9), (15, 0.95), (20, 0.97), (40, 1.0), (200, 1.0)])
def test_many_words_one_word_apart(spark, n, least):
    rng = random.Random(n)
    pairs = []
    for _ in range(100):
        a = [word(rng) for _ in range(n)]
        at = rng.randrange(n)
        pairs.append((" ".join(a), " ".join([*a[:at], word(rng), *a[at + 1 :]])))
    got = sharing(spark, pairs)
    assert sum(got.values()) >= least * len(got)


def test_unlike_lines_share_none(spark):
    rng = random.Random(8)
    pairs = [tuple(" ".join(word(rng) for _ in range(n)) for _ in range(2)) for n in (1, 2, 6, 9, 12, 40) for _ in range(30)]
    assert not any(sharing(spark, pairs).values())
