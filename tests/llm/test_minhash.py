"""DartMinHash and near-duplicate classes against exact similarities."""

import random

import numpy as np
import pytest

from modspark.llm import minhash


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(3)
    k = 4000
    for low, high, n in ((1, 2, 300), (1, 40, 60), (1, 3, 2), (500, 900, 5)):
        e = rng.integers(1, 2**63, n, dtype=np.uint64)
        a, b = rng.integers(low, high, n), rng.integers(low, high, n)
        drop = rng.random(n) < 0.2
        ea, wa, eb, wb = e, a, e[~drop], b[~drop]
        full = np.zeros(n, np.int64)
        full[~drop] = wb
        want = np.minimum(a, full).sum() / np.maximum(a, full).sum()
        got = minhash.signatures(np.concatenate([ea, eb]), np.concatenate([wa, wb]), np.array([len(ea), len(eb)]), k)
        assert abs((got[0] == got[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / k) + 1e-9
        assert (got != minhash.NONE).all()


def test_a_signature_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(4)
    sets = [(rng.integers(1, 2**63, n, dtype=np.uint64), rng.integers(1, 9, n)) for n in (1, 50, 0, 7, 400)]
    size = np.array([len(e) for e, _ in sets])
    all_ = minhash.signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]), size, 128)
    for i, (e, w) in enumerate(sets):
        assert (minhash.signatures(e, w, np.array([len(e)]), 128)[0] == all_[i]).all()


def similarity(a, b):
    return minhash.weighted_jaccard(minhash.shingles(minhash.word_hashes(a)), minhash.shingles(minhash.word_hashes(b)))


def test_weighted_jaccard_and_packed_sets():
    from collections import Counter

    rng = random.Random(1)
    for _ in range(50):
        a, b = (" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(2))
        runs = [Counter(zip(*(t.split()[k:] for k in range(5)), strict=False)) if len(t.split()) > 4 else Counter([tuple(t.split())]) for t in (a, b)]
        want = sum((runs[0] & runs[1]).values()) / sum((runs[0] | runs[1]).values())
        assert abs(similarity(a, b) - want) < 1e-12
        assert abs(minhash.weighted_jaccard(minhash.unpacked_set(minhash.packed_set(a)), minhash.unpacked_set(minhash.packed_set(b))) - want) < 1e-12


SCHEMA = "doc_id long, text string, band string, id int, root int"


def brute(rows):
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [minhash.shingles(minhash.word_hashes(t or "")) for _, t, *_ in rows]
    for i in range(n):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and minhash.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0] if rows[i][0] is not None else 1 << 62)
    return sorted(sorted(g) for g in groups.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 1)] = [str(rng.random())]
    return words


def rows_of(rng):
    rows, ids = [], iter(rng.sample(range(10**6), 5000))
    for size in (1, 1, 1, 2, 3, 5, 9, 40, 60):
        base = [rng.choice(["aa", "bb", "cc", "dd", "ee", str(rng.randint(0, 500))]) for _ in range(rng.randint(40, 200))]
        for _ in range(size):
            text = " ".join(edited(rng, base, rng.randint(0, 3)))
            rows += [(next(ids), text.upper() if rng.random() < 0.2 else text, "", 0, 0)] * (1 + (rng.random() < 0.05))
    rows += [(next(ids), "same words  in all", "", 0, 0) for _ in range(150)]
    chain = [str(i) for i in range(100)]
    for _ in range(25):  # neighbours are similar, ends are not
        rows.append((next(ids), " ".join(chain), "", 0, 0))
        chain = [*chain[3:], *(str(rng.random()) for _ in range(3))]
    rows += [(None, None, None, None, None), (None, "", "", 0, 0), (1, "", "", 0, 0), (2, None, "", 0, 0), (3, "one", "", 0, 0), (4, "One ", "", 0, 0)]
    rows += [(None, "one", "", 0, 0), (5, "x " * 50_000, "", 0, 0), (6, "x " * 49_000, "", 0, 0), (7, "x " * 30_000, "", 0, 0)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    rows = rows_of(random.Random(seed))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    big = 1 << 62
    assert sorted((g[0], len(g)) for g in want) == sorted(((r.class_id if r.class_id is not None else big), r.class_size) for r in got if r.kept)
    name = {i: (g[0], len(g)) for g in want for i in g if i != big}
    for r in got:
        if r.doc_id is not None:
            assert (r.class_id, r.class_size) == name[r.doc_id]
        assert not r.kept or r.doc_id == r.class_id


def test_a_large_bucket_of_a_template(spark):
    """Texts of one template with their own words in it: many alike, many too far apart, all in large buckets."""
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 4, 6, 8, 12]))), "", 0, 0) for i in range(220)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: g[0] for g in brute(rows) for i in g}
    assert got == want and 10 < len(set(got.values())) < 200


def test_bounds_lose_no_pair(spark):
    rng = random.Random(11)
    base = [str(rng.random()) for _ in range(60)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 5)) + ["x"] * rng.choice([0, 0, 9, 30])) for _ in range(90)]
    raw = [minhash.packed_set(t) for t in texts]
    sets = spark.createDataFrame(list(enumerate(raw)), "id long, set binary")
    apart = spark.createDataFrame([(1, i, i, len(raw)) for i in range(len(raw))], "band long, id long, root long, n long")
    got = {tuple(r) for r in minhash.rare_pairs(apart, sets, 0.8).distinct().collect()}
    near = {(i, j) for j in range(90) for i in range(j) if minhash.weighted_jaccard(minhash.unpacked_set(raw[i]), minhash.unpacked_set(raw[j])) >= 0.8}
    assert near and near <= got and len(got) < 90 * 89 / 2


def test_keep_one_takes_any_columns(spark):
    rows = [(1, "a b c d e f", 7, "x", 1.0, "k"), (2, "a b c d e f", 8, "y", 2.0, "l"), (3, "z y x w v u", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, key_ string, nth double, `id_` string")
    assert sorted(map(tuple, minhash.keep_one(docs).collect())) == [rows[0], rows[2]]


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
