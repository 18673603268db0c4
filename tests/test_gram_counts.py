"""Grams are counted as texts are read: one row a gram and task, the same counts as a plain loop."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from modspark.operators import langid


def counts(rows, languages, n=3):
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 7]], pa.string()) for k in (0, 1)], ["language", "text"]) for i in range(0, len(rows), 7)]
    return [r for b in langid._gram_counts(languages, n)(iter(batches)) for r in b.to_pylist()]


@pytest.mark.parametrize("dense, chunk", [(1 << 23, 1 << 21), (0, 1 << 21), (1 << 23, 50)])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_counts_equal_a_loop(monkeypatch, dense, chunk, n):
    monkeypatch.setattr(langid, "_DENSE", dense)
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    rng = random.Random(n)
    rows = [(rng.choice("ab"), "".join(rng.choice("xyzé🙂\U0010ffff\0\n") for _ in range(rng.choice([0, 1, 2, 3, 40])))) for _ in range(60)]
    want = {x: Counter(t[i : i + n] for lang, t in rows if lang == x for i in range(len(t) - n + 1)) for x in "ab"}
    got = {x: Counter() for x in "ab"}
    for r in counts(rows, ["a", "b"], n):
        got["a"][r["gram"]] += r["_0"]
        got["b"][r["gram"]] += r["_1"]
    assert {x: +got[x] for x in "ab"} == want


def test_one_row_a_gram():
    rows = [("a", "the same text again")] * 1000
    assert len(counts(rows, ["a"])) == len({rows[0][1][i : i + 3] for i in range(17)})


def test_no_row_for_each_gram_in_the_plan(spark):
    df = spark.createDataFrame([("aa", "abcabc")], "lang string, text string")
    plan = langid.train_profiles(df, ["aa"], "text", "lang")._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_a_text_that_is_long_enough_only_in_lower_case_is_left_out(spark):
    df = spark.createDataFrame([("aa", "\u0130\u0130"), ("aa", "abcd")], "lang string, text string")
    assert {r.gram for r in langid.train_profiles(df, ["aa"], "text", "lang").collect()} == {"abc", "bcd"}
