import hashlib
import random

import numpy as np
import pytest

from modspark.llm.minhash import mixed
from modspark.llm.orderhash import _FUNCTIONS, _MULTIPLY, _OCCURRENCE, _ODD, K, L, M, code_points, edited, fingerprints, kmers, likeness, order_minhash, with_edited

MASK = 2**64 - 1


def plain(text: str) -> str:
    """The same by loops: every function sorts all numbered k-mers."""
    if not text:
        return "0" * 8 * M
    runs = [text[i : i + K] for i in range(max(1, len(text) - K + 1))]
    one = lambda x: int(mixed(np.array([x & MASK], np.uint64))[0])
    seen: dict[str, int] = {}
    items = []
    for place, run in enumerate(runs):
        h = min(len(text), K)
        for c in run:
            h = (h * int(_MULTIPLY) + ord(c)) & MASK
        h = one(h)
        number = seen[run] = seen.get(run, -1) + 1
        items.append((one(h + number * int(_OCCURRENCE)), place, h))
    out = ""
    for f, odd in zip(_FUNCTIONS.tolist(), _ODD.tolist(), strict=True):
        chosen = sorted(items, key=lambda x: ((x[0] >> 32) * odd & 0xFFFFFFFF, x[0]))[:L]
        total = f
        for _, _, h in sorted(chosen, key=lambda x: x[1]):
            total = one(total * int(_MULTIPLY) + h)
        out += f"{max(total >> 32, 1):08x}"
    return out


def hexed(text: str) -> str:
    return order_minhash(code_points(text)).astype(">u4").tobytes().hex()


@pytest.mark.parametrize("text", ["", "a", "abc", "abcdefgh", "abcdefghi", "ab" * 40, "é漢😀" * 9, " ".join(f"w{i % 7}" for i in range(120))])
def test_fingerprint_is_brute_force(text):
    assert hexed(text) == plain(text)


def test_long_texts_are_brute_force():
    rng = random.Random(1)
    text = "".join(rng.choice("abcde \n") for _ in range(3000))
    assert hexed(text) == plain(text)
    # Over several blocks, against all values at once.
    codes = code_points("".join(rng.choice("abcdefghij ") for _ in range(30_000)))
    h, numbered = kmers(codes)
    with np.errstate(over="ignore"):
        value = _ODD[:, None] * (numbered >> np.uint64(32)).astype(np.uint32)
        at = np.sort(np.lexsort((np.broadcast_to(numbered, value.shape), value))[:, :L], axis=1)
        want = _FUNCTIONS.copy()
        for j in range(L):
            want = mixed(want * _MULTIPLY + h[at][:, j])
    assert (order_minhash(codes) == np.maximum(want >> np.uint64(32), 1)).all()


def test_likeness_falls_with_edits_and_moves():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    base = order_minhash(code_points(" ".join(words)))
    near = []
    for changed in (0, 4, 16, 64, 400):
        new = list(words)
        for i in rng.sample(range(400), changed):
            new[i] = "".join(rng.choice("qrstuvwxyz") for _ in range(6))
        near.append(likeness(base, order_minhash(code_points(" ".join(new)))))
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[1] > 0.8 and near[-1] < 0.05
    # The same k-mers in another order: a set would not see it.
    moved = " ".join(words[200:] + words[:200])
    assert likeness(base, order_minhash(code_points(moved))) < 0.75


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        new = edited(text, following)
        a, b, c = (order_minhash(code_points(t)) for t in (text, new, following))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), hexed(text), hexed(new), likeness(a, b), likeness(a, c)))
    return out


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_query_is_brute_force(spark, parts):
    rng = random.Random(3)
    texts = [None, "", "x", "é😀", "same text here " * 20, "same text here " * 20] + ["".join(rng.choice("abc déf\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id"), (1000, "long " * 40_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, nth int, part string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = with_edited(table.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(rows), key=repr)


def test_repeated_rows_follow_each_other(spark):
    rows = [(5, "five " * 30)] * 40 + [(4, "four " * 30)] + [(None, None)] * 3
    got = sorted((tuple(r) for r in with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert with_edited(spark.createDataFrame([], schema)).collect() == []
    (row,) = with_edited(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    (row,) = fingerprints(spark.createDataFrame([(1, None)], schema)).collect()
    assert row["fingerprint"] == "0" * 8 * M
