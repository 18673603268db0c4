"""Recall against brute-force edit similarity, by kind of change."""

import random

from pyspark.sql import functions as F

from modspark.llm import lines


def planted(rng):
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    for n in (1, 3, 5, 10, 20, 40):
        for _ in range(60):
            a = [rng.choice(words) for _ in range(n)]
            b, k = list(a), rng.randrange(n)
            if n < 10:
                at = rng.randrange(len(b[k]))
                b[k] = b[k][:at] + rng.choice("uvwxyz") + b[k][at + 1 :]
            else:
                b[k] = rng.choice(words)
            yield n, " ".join(a), " ".join(b)


def test_recall(spark):
    rows = [(i, n, a, b) for i, (n, a, b) in enumerate(planted(random.Random(5)))]
    df = spark.createDataFrame(rows, "i long, n long, a string, b string")
    held = {r.i for r in df.where(F.levenshtein("a", "b") <= 0.2 * F.greatest(F.length("a"), F.length("b"))).collect()}
    docs = spark.createDataFrame([(2 * i + k, t) for i, _, a, b in rows for k, t in ((0, a), (1, b))], "doc_id long, text string")
    gone = {r.doc_id for r in lines.repeated_lines(docs).where("n_removed > 0").collect()}
    share = {}
    for n in (1, 3, 5, 10, 20, 40):
        these = [i for i, m, *_ in rows if m == n and i in held]
        share[n] = sum(2 * i + 1 in gone for i in these) / len(these)
    print("recall", share)
    assert min(share[n] for n in (1, 3, 5, 40)) == 1 and min(share[10], share[20]) >= 0.95
