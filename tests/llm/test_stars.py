"""Components by stars, pairs that are asked for, votes of very many words."""

import random

import pytest
from pyspark.sql import functions as F

from modspark.llm import cluster, lines


@pytest.mark.parametrize("kind", ["stars", "path", "cycle", "mixed", "none"])
def test_components(spark, monkeypatch, kind):
    rng = random.Random(4)
    links = {
        "stars": [(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 60)],
        "path": [(i, i + 1) for i in range(30)],
        "cycle": [(i, (i + 1) % 25) for i in range(25)] + [(3, 3)],
        "mixed": [tuple(rng.sample(range(100), 2)) for _ in range(70)] * 2,
        "none": [],
    }[kind]
    root = list(range(100))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    written = []
    monkeypatch.setattr(cluster, "stored", lambda df, name, f=cluster.stored: written.append(name) or f(df, name))
    got = cluster.connected(spark.createDataFrame(links, "a long, b long"), "components").collect()
    assert {r.id: r.root for r in got} == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert len(got) == len({r.id for r in got})
    # Stars are seen to be stars at once: no round is spent on seeing that nothing changes.
    assert (len(written) == 1) == (kind in ("stars", "none"))


def test_no_pairs_no_comparison(spark):
    """Nothing is compared where no pair is left."""
    asked = []
    rows = spark.range(6).select("id", F.array(F.lit(1).cast("long")).alias("bands"))

    def verified(pairs):
        asked.append(pairs.count())
        return pairs

    _, roots = cluster.linked(cluster.bucket_members(rows), verified)
    assert {(r.id, r.root) for r in roots.collect()} == {(i, 0) for i in range(6)}
    assert asked == [5]


@pytest.mark.parametrize("n", [2, 1023, 1024, 5000])
def test_simhash_of_very_many_words(spark, n):
    rng = random.Random(n)
    own = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    got = spark.createDataFrame([(own,)], "h array<long>").select(lines.simhash(F.col("h"))).first()[0] & (2**64 - 1)
    assert got == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > n)
