"""Language of a text found in its row: against the joined form and a plain loop."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from modspark.operators import langid

LANGUAGES = ["aa", "bb", "cc"]


def corpus(spark):
    rng = random.Random(7)
    letters = {"aa": "abcdeé ", "bb": "defgh🙂 ", "cc": "ghijkअ "}
    rows = [(i, x, "".join(rng.choice(letters[x]) for _ in range(rng.choice([0, 1, 2, 3, 40])))) for i, x in enumerate(rng.choices(LANGUAGES, k=300))]
    rows += [(1000, "aa", None), (1001, "dd", "zzzz"), (1002, None, "ABCDE" * 3000), (1003, "bb", "zzzz"), (1003, "bb", "zzzz")]
    return rows, spark.createDataFrame(rows, "id long, lang string, text string")


def plain(rows):
    """The same by a loop over every text."""
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    counts = {x: Counter(g for _, lang, t in rows if lang == x and t for g in grams(t.lower())) for x in LANGUAGES}
    every = set().union(*counts.values())
    sizes = {x: sum(counts[x].values()) + len(every) for x in LANGUAGES}

    def weight(g, x):
        v = 1000 * math.log((counts[x][g] + 1) / sizes[x])
        return int(math.copysign(math.floor(abs(v) + 0.5), v))

    out = {}
    for i, _, t in rows:
        known = [g for g in grams((t or "").lower()) if g in every]
        sums = [sum(weight(g, x) for g in known) for x in LANGUAGES]
        out[i] = LANGUAGES[sums.index(max(sums))] if known else None
    return out


def test_in_the_row_equals_the_join_and_a_loop(spark):
    rows, df = corpus(spark)
    profiles = langid.train_profiles(df, LANGUAGES, "text", "lang")
    in_row = {r.id: r.predicted for r in langid.identify(df, profiles, LANGUAGES, "id", "text").collect()}
    unique = df.dropDuplicates(["id"])
    joined = {r.id: r.predicted for r in langid.identify(unique, profiles, LANGUAGES, "id", "text", max_bytes=0).collect()}
    assert in_row == joined == plain(rows)
    assert set(in_row.values()) == {*LANGUAGES, None}


def test_no_shuffle_after_the_training(spark):
    _, df = corpus(spark)
    predicted = langid.predictor(langid.train_profiles(df, LANGUAGES, "text", "lang"), LANGUAGES)
    plan = df.select("id", predicted(F.col("text")).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_long_texts_in_steps_and_empty_tables(spark, monkeypatch):
    rows, df = corpus(spark)
    profiles = langid.train_profiles(df, LANGUAGES, "text", "lang")
    grams = langid._packed(langid._points("abcxyz"), 3)[::3]
    assert langid._best(["abcabc", "", "xy", "xyz"], grams, langid.np.array([[1, 0], [0, 5]]), 3) == [0, -1, -1, 1]
    none = langid.train_profiles(df.limit(0), LANGUAGES, "text", "lang")
    assert [r.predicted for r in langid.identify(df.limit(3), none, LANGUAGES, "id", "text").collect()] == [None] * 3
    assert langid.identify(df.limit(0), profiles, LANGUAGES, "id", "text").count() == 0
