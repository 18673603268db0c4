import math

import numpy as np
import pytest

from modspark.llm.hardneg import Heaps, hard_negatives, integers, mined, moved_label, products, strassen, window

SCHEMA = "vec_id long, label long, embedding array<double>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 0, 3), (33, 64, 40), (70, 129, 35), (128, 65, 257)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (strassen(a, b, leaf=8) == a @ b).all()
    big, other = a * 2**21, b * 2**9  # leaves beyond exact doubles
    assert (strassen(big, other, leaf=8) == big @ other).all()
    assert (strassen(a.astype(object), b.astype(object), leaf=16) == a @ b).all()


def test_products_beyond_a_long_are_the_nearest():
    v = integers(np.array([[1e300, 2.0], [3.5, -1.0]]))
    got = products(v, v)
    assert got[0, 0] == 2**63 - 1
    assert got[1, 1] == (3.5 * 256) ** 2 + 256**2
    assert integers(np.array([[1e306]]))[0, 0] == int(1e306) * 256


def test_window_is_exact():
    for score in range(-300, 301):
        lo, hi = window(score)
        inside = [s for s in range(-400, 401) if 50 * score <= 100 * s <= 95 * score]
        assert inside == list(range(lo, hi + 1))


def test_heaps_merge():
    rng = np.random.default_rng(3)
    scores, names = rng.integers(0, 6, (4, 60)), np.sort(rng.integers(0, 40, 60))
    fits = rng.random((4, 60)) < 0.7
    heaps, slots = Heaps(4, 3), np.array([2, 0, 1, 3])
    for part in np.array_split(np.arange(60), 7):
        heaps.offer(slots, scores[:, part], names[part], fits[:, part])
    slot, score, name = heaps.rows()
    for i, s in enumerate(slots.tolist()):
        want = sorted((-int(scores[i, j]), int(names[j])) for j in range(60) if fits[i, j])[:3]
        assert [(-int(x), int(y)) for x, y in zip(score[slot == s], name[slot == s], strict=True)] == want


def brute(rows):
    ok = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {}
    for r in sorted(ok):
        if r[0] % 50 == 0:
            anchors.setdefault(r[0], r)
    out = []
    for i, label, v in anchors.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in ok if j != i and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, p, rank, s[1], -ps, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out)


def corpus(n=700, dim=33):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(4, dim))
    rows = [(i, int(i % 4), [float(x) for x in middle[i % 4] * 0.6 + middle[0] * 0.5 + rng.normal(size=dim) * 0.4]) for i in range(n)]
    rows += rows[40:60]  # repeated rows, one of them an anchor's
    rows += [(1001, None, rows[0][2]), (1050, 1, None), (1002, 1, [None] * dim), (1003, 2, [float("nan")] * dim), (1004, 2, [float("inf")] * dim)]
    rows += [(None, 1, rows[1][2]), (1100, 1, [0.0] * dim), (1150, 1, []), (1151, 2, []), (1152, 1, []), (1200, 1, [1.0, 2.0]), (1201, 1, [1.0, 2.0]), (1202, 3, [1.0, 1.0])]
    return rows


def test_query_is_brute_force(spark):
    rows = corpus()
    table = spark.createDataFrame([(*r, 3, "a") for r in rows], SCHEMA + ", rank int, slot string").repartition(6)
    assert sorted(tuple(r) for r in mined(table).collect()) == brute(rows)


def test_one_label_holds_most_and_all_tie(spark):
    rows = [(i, 1, [0.5, 0.25]) for i in range(1, 400) if i % 7] + [(400, 1, [0.5, 0.25])] + [(i, 2, [0.375, 0.25]) for i in range(1001, 1060)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in mined(table).collect()) == brute(rows)


def test_blocks_of_anchors_give_the_same(spark):
    table = spark.createDataFrame(corpus(), SCHEMA).withColumn("label", moved_label())
    anchors = table.where("vec_id % 10 = 0")
    whole = sorted(tuple(r) for r in hard_negatives(table, anchors).collect())
    cut = sorted(tuple(r) for r in hard_negatives(table, anchors, block_bytes=6000).collect())
    assert whole == cut and whole


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty).collect() == []
    assert mined(spark.createDataFrame([(50, 1, [1.0])], SCHEMA)).collect() == []
    huge = spark.createDataFrame([(50, 1, [1e300]), (51, 1, [1e300]), (52, 2, [1e300])], SCHEMA)
    assert mined(huge).collect() == []
