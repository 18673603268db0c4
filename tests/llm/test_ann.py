"""Neighbours against brute force; error bounds against the errors."""

import math
import random

import numpy as np
import pytest

from modspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def brute(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            got = sorted((-(float((v * w).sum())), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in got[:k]]
    return out


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_recall_and_order(spark, dim):
    rng = np.random.default_rng(dim)
    centers = rng.normal(size=(5, dim))
    rows = [(int(i), (centers[i % 5] + rng.normal(size=dim)).tolist(), 0, 0, 0.0) for i in range(700)]
    rows += [(700 + i, rows[3][1], 0, 0, 0.0) for i in range(60)]  # many equal ones
    rows += [(1000, None, 0, 0, 0.0), (1020, [], 0, 0, 0.0), (1040, [0.0] * dim, 0, 0, 0.0), (1060, [float("nan")] * dim, 0, 0, 0.0)]
    rows += [(1080, [float("inf")] * dim, 0, 0, 0.0), (1100, [None] * dim, 0, 0, 0.0), (None, [1.0] * dim, 0, 0, 0.0), (1120, [1.0] * 7, None, None, None), (1121, [2.0] * 7, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), query_block=15).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == {q for q, v in want.items() if v}
    hit = total = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        scores = dict(want[q]) | {i: s for i, s in want[q]}
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found if i in scores)
        assert len(found) == len(want[q])
        hit += len({i for _, i, _ in found} & set(scores))
        total += len(want[q])
    assert hit / total > 0.99


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    center = v.mean(0)
    est, off = ann.bounds(*ann.encode(v, center), q, center)
    assert (np.abs(est - q @ v.T) <= off).mean() > 0.995
    assert abs((est - q @ v.T).mean()) < 0.05  # without bias


def test_empty_and_alone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, none).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 0, 0, 0.0)], SCHEMA)
    assert ann.nearest(one, one).count() == 0
    rng = random.Random(1)
    few = spark.createDataFrame([(i, [rng.random(), rng.random()], 0, 0, 0.0) for i in range(5)], SCHEMA)
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4
