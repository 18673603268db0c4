"""Large buckets: every two members end in one class or were compared."""

import random

import pytest
from pyspark.sql import functions as F

from modspark.llm import cluster


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("n, buckets", [(2500, 1)])
def test_planted_pairs_of_large_buckets(spark, n, buckets):
    """Templated texts: all in the same buckets, few of them links, most between two that lead nothing."""
    rng = random.Random(n)
    planted = {tuple(sorted(rng.sample(range(1, n), 2))) for _ in range(n // 10)}
    links = spark.createDataFrame(sorted(planted), "a long, b long")
    rows = spark.range(n).select("id", F.array(*map(F.lit, range(buckets))).cast("array<long>").alias("bands"))
    members = cluster.bucket_members(rows)
    found, roots = cluster.linked(members, lambda pairs: pairs.join(links, ["a", "b"]))
    assert {(r.a, r.b) for r in found.collect()} <= planted
    root = {r.id: r.root for r in roots.collect()}
    assert [root.get(x, x) for x in range(n)] == components(n, planted)
