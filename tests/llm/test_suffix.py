"""Suffix arrays and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from modspark.llm import suffix


def brute_array(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays():
    rng = random.Random(1)
    cases = [[0], [1, 0], [2, 1, 0], [1, 2, 0], [5] * 40 + [0], [1, 2] * 30 + [0]]
    for _ in range(300):
        top = rng.choice([2, 3, 5, 250])
        cases.append([rng.randint(1, top) for _ in range(rng.randint(0, 200))] + [0])
        unit = [rng.randint(1, 4) for _ in range(rng.randint(1, 30))]
        cases.append((unit * 8)[: rng.randint(1, 200)] + [rng.randint(1, 4)] + unit * 3 + [0])
    for c in cases:
        assert suffix.suffix_array(np.array(c, np.int32), 258).tolist() == brute_array(c)
        assert suffix._by_lists(c, 258) == brute_array(c)


def test_permuted_prefixes():
    rng = random.Random(2)
    for _ in range(50):
        raw = np.array([rng.randint(1, 2) for _ in range(150)] + [0], np.uint8)
        sa = suffix.suffix_array(raw.astype(np.int32), 258)
        left = np.arange(len(raw))[::-1].copy()
        got = suffix.permuted_prefixes(raw, left, sa, 20)
        b = raw.tobytes()
        for x, y in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < min(20, left[x], left[y]) and b[x + n] == b[y + n]:
                n += 1
            assert got[y] == n


def brute(rows):
    first = {}
    data = [((i if i is not None else 2**63 - 1), i, (t or "").encode()) for i, t, *_ in rows]
    for o, _, t in data:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, o), o)
    out = []
    for o, i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < o:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n, words):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    passages = [" ".join(rng.choice(some) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            k = rng.randint(0, len(p))
            parts += [p[k:] if rng.random() < 0.3 else p, " ".join(rng.choice(some) for _ in range(rng.randint(0, 6)))]
        rows.append((rng.randint(0, 10**6) * 1000 + i, "".join(parts), i))
    return rows


SCHEMA = "doc_id long, text string, key int"


def answer(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, suffix.repeated_passages(df).collect()), key=repr)


@pytest.mark.parametrize("seed,n,words", [(1, 60, 200), (2, 200, 8), (3, 150, 3000)])
def test_against_brute_force(spark, seed, n, words):
    rows = rows_of(seed, n, words)
    assert answer(spark, rows) == brute(rows)


def test_odd_rows(spark):
    line = "the licence of this text is that of all the others, and so on."
    rows = [
        (1, None, 0), (2, "", 0), (3, "short", 0), (None, line, 0), (None, line + "x", 0), (4, line * 3, 0), (4, line * 3, 0),
        (4, "another text " + line, 0), (5, line + line[:49], 0), (6, "a" * 300, 0), (7, "a" * 49, 0), (8, "ba" + "a" * 50, 0),
        (9, line[:50], 0), (10, line[1:50], 0), (11, "\0" * 60, None), (12, "\0" * 70, None), (13, ("é" * 30 + line) * 400, 1),
        (14, "z" + ("é" * 30 + line) * 3, 1),
    ]
    rows += [(100 + i, f"{i * i} {line} {i}", 0) for i in range(120)] + [(500 + i, line * 2, 0) for i in range(40)]
    assert answer(spark, rows) == brute(rows)


def test_slices_do_not_matter(spark):
    rows = rows_of(5, 120, 50)
    whole = answer(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert answer(spark, rows) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert answer(spark, []) == []
