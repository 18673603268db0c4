"""Near-equal lines against brute force."""

import random
import re

from pyspark.sql import functions as F

from modspark.llm import lines

SCHEMA = "doc_id long, text string, line string, key int, keep int"


def norm(line):
    return re.sub(r"\s+", " ", re.sub(r"\d", "0", line.lower())).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def close(a, b):
    return distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def hashes(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, norm string")
    sims = df.withColumn("hashes", lines.word_hashes(F.col("norm"))).select("i", lines.simhash(F.col("hashes")).alias("sim"))
    return {r.i: r.sim & (2**64 - 1) for r in sims.collect()}


def test_simhash_bits(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["x y " * 40_000 + "x"]
    words = sorted({w for t in texts for w in t.split()})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"))
    h = {r.w: r.h & (2**64 - 1) for r in df.collect()}
    got = hashes(spark, [t.strip() for t in texts])
    for i, t in enumerate(texts):
        own = [h[w] for w in t.split()]
        assert got[i] == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own))


def rows_of(rng):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    hot = "this line is in nearly all of the texts 17"
    long_ = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(60):
        own = [hot.replace("17", str(rng.randint(10, 99)))] if rng.random() < 0.7 else []
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(long_).split()
            if rng.random() < 0.6:
                line[rng.randrange(40)] += rng.choice("xyz")
            own.append(" ".join(line))
        own += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(2)] + [""]
        rng.shuffle(own)
        rows.append((rng.randint(0, 99) * 100 + i, "\n".join(own), "", 0, 0))
    return rows + [(None, "unique to nobody\n" + hot, None, None, None), (7, None, "", 0, 0), (8, "", "", 0, 0), (9, "\n\n", "", 0, 0), rows[0], (11, "w " * 50_000, "", 0, 0)]


def test_lines(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lines.repeated_lines(docs).collect()
    assert len(got) == len(rows)
    place = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0] if r[0] is not None else 1 << 62):
        for k, line in enumerate((t or "").split("\n")):
            place.setdefault((i, k), norm(line))
    texts = sorted({t for t in place.values() if t})
    df = spark.createDataFrame(list(enumerate(texts)), "i long, norm string")
    keys = {r.i: set(r["keys"]) for r in df.select("i", lines.line_keys(F.col("norm")).alias("keys")).collect()}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if keys[a] & keys[b] and max(len(texts[a]), len(texts[b])) < 5000 and close(texts[a], texts[b]):
                root[find(a)] = find(b)
    at = {t: a for a, t in enumerate(texts)}
    gone = {(r.doc_id, k) for r in got for k in r.removed_lines}
    seen = set()
    for p, t in place.items():
        # Blank lines stay; of each group of lines that share a key and are close only the first does.
        assert (p in gone) == (bool(t) and find(at[t]) in seen)
        if t:
            seen.add(find(at[t]))
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        assert r.n_lines == len(text.split("\n")) and r.n_removed == len(r.removed_lines)
    cut = lines.dedup_lines(docs)
    assert cut.columns == docs.columns
    by = {r.doc_id: r.removed_lines for r in got}
    for r in cut.collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        want = text if text is None or not by[r.doc_id] else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in by[r.doc_id])
        assert r.text == want


def test_columns_of_any_name(spark):
    rows = [(1, "a line of words here", 5, "k", "g", "r"), (2, "a line of words here\nother", 6, "l", "h", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ord_ long, key_ string, gone_ string, row string")
    got = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    assert got == [rows[0], (2, "other", 6, "l", "h", "s")]


def test_empty(spark):
    assert lines.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
