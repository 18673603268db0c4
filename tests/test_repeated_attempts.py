"""Rate-limited attempts that share an id, or have none."""

import pytest
from pyspark.sql import functions as F

from modspark.plans import moderation

SCHEMA = "message_id long, text string, user_id string, second long, arrival long"
SAME = [(1, "fine", "u", 0, 0)] * 30
RETRIES = [(1, f"fine {i}", "u", 0, i) for i in range(30)]
NULLS = [(None, f"fine {i}", "u", 0, i) for i in range(30)] + [(None, "fine", "v", 0, i) for i in range(3)]
ALIKE = [(1, f"fine {i}", "u", 0, 0) for i in range(30)]
TIES = [(i, f"fine {i}", "u", 0, 0) for i in range(30)]
UNKNOWN = [(1, "fine", None, 0, 0), (1, "fine", "u", None, 0)] + RETRIES


@pytest.mark.parametrize("rows", [SAME, RETRIES, NULLS, ALIKE, TIES, UNKNOWN])
def test_every_attempt_comes_out_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = moderation.moderate(df, limits=(20, 60))
    keys = ["message_id", "user_id", "second", "arrival", "text"]
    refused = [tuple(r) for r in out.rejected.select(*keys).collect()]
    passed = [tuple(r) for r in out.results.select(*keys).collect()]
    assert len(refused) == 10 and all(r[1] == "u" for r in refused)

    assert sorted(map(repr, refused + passed)) == sorted(repr((r[0], r[2], r[3], r[4], r[1])) for r in rows)
    assert sorted(r.prior for r in out.rejected.select("prior").collect()) == list(range(20, 30))
    assert moderation.every_message(out).where(F.col("status") == "RATE_LIMITED").count() == 10
