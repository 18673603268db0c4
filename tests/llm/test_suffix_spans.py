"""Only spans that another document may hold too go through the suffix arrays."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa

from modspark.llm import suffix


def test_spans_hold_every_shared_string():
    rng = random.Random(4)
    for _ in range(30):
        rows, at, length, gram, order = [], [], [], [], []
        for g in range(4):
            middle = bytes(rng.randrange(97, 123) for _ in range(20))
            for _ in range(rng.randint(1, 12)):
                a, b = rng.choice([0, 7, 30]), rng.choice([0, 11, 30])
                text = bytes(rng.choice(b"xy" if i not in (4, 40) else b"ab") for i in range(30))
                rows.append((text[:a][::-1] + middle + text[30 - b :]).ljust(80, b"\0"))
                at.append(a)
                length.append(a + 20 + b)
                gram.append(g)
                order.append(rng.randint(1, 6))
        table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 80)
        low, high = suffix.shared_spans(table, *(np.array(x, np.int64) for x in (length, at)), np.array(gram, np.uint64), np.array(order))
        for i in range(len(rows)):
            held = []
            for s in range(max(0, at[i] - 30), min(at[i], length[i] - 50) + 1):
                other = [j for j in range(len(rows)) if gram[j] == gram[i] and order[j] != order[i] and 0 <= at[j] - at[i] + s <= length[j] - 50]
                if any(rows[j][at[j] - at[i] + s :][:50] == rows[i][s : s + 50] for j in other):
                    held.append(s)
            assert (low[i], high[i]) == ((held[0], held[-1] + 50) if held else (0, 0))


def test_a_common_phrase_is_not_sorted(monkeypatch):
    """Contexts that differ all around a phrase stay out of the arrays; two that share a string are found."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = "according to the latest report"
    texts = [word(60) + phrase + word(60) for _ in range(200)] + [word(60) + phrase + "Q" * 9 + "the same words go on here again" + word(9) for _ in range(2)]
    n = len(texts)
    ids = pa.array(range(n), pa.int64())
    at = [np.array([60 + 4], "<u4").tobytes()] * n  # a gram within the phrase
    no = pa.array([[]] * n, pa.list_(pa.binary()))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts), pa.array([[x] for x in at], pa.list_(pa.binary())), no, no, pa.array([False] * n)], ["ord", "key", "text", "starts", "span_starts", "span_ends", "whole"])
    blobs = pd.concat([b.to_pandas() for b in suffix._cut_contexts(1)(iter([batch]))])
    sorted_, plain = [], suffix.least_documents
    monkeypatch.setattr(suffix, "least_documents", lambda c, *a: sorted_.append(len(c)) or plain(c, *a))
    told = suffix._covered(blobs)
    assert told["key"].tolist() == [n - 1] and sum(sorted_) == 2
