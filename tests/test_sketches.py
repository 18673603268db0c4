"""Percentiles from mergeable sketches: within the stated error, also after two roll-ups."""

import datetime
import random

from modspark.operators import monitor

START = datetime.datetime(2025, 1, 1)


def test_roll_ups_stay_within_the_error(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30_000):
        kind = "hot" if rng.random() < 0.8 else "cold"
        value = rng.choice([0.0001 * rng.random(), rng.lognormvariate(3, 2), 5.0, float(i)])
        rows.append((START + datetime.timedelta(seconds=rng.randrange(86_400)), kind, value))
    log = spark.createDataFrame(rows, "ts timestamp, kind string, ms double")
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    minutes = monitor.latency_sketches(log, "ts", "ms", "1 minute", ["kind"])
    direct = monitor.latency_sketches(log, "ts", "ms", "1 day", ["kind"])
    rolled = monitor.roll_up(monitor.roll_up(minutes, "1 hour", ["kind"]), "1 day", ["kind"])
    everything = monitor.roll_up(minutes, "1 day", [])
    for table, kinds in ((direct, ["hot", "cold"]), (rolled, ["hot", "cold"]), (everything, [None])):
        got = monitor.sketched_percentiles(table, shares).collect()
        assert len(got) == len(kinds)
        for r in got:
            values = sorted(v for _, kind, v in rows if "kind" not in r or kind == r.kind)
            assert r.requests == len(values)
            for name, share in shares.items():
                below, upto = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
                assert below / len(values) <= share + monitor.RANK_ERROR and upto / len(values) >= share - monitor.RANK_ERROR


def test_small_groups_are_exact_and_nulls_count_as_requests(spark):
    rows = [(START, "a", float(i)) for i in range(100)] + [(START, "b", None), (None, "a", 1.0), (START, None, 4.0)]
    log = spark.createDataFrame(rows, "ts timestamp, kind string, ms double")
    sketches = monitor.roll_up(monitor.latency_sketches(log, "ts", "ms", "1 minute", ["kind"]), "1 day", ["kind"])
    got = {r.kind: (r.requests, r.p50) for r in monitor.sketched_percentiles(sketches, {"p50": 0.5}).collect()}
    assert got == {"a": (100, 49.0), "b": (1, None), None: (1, 4.0)}
    assert monitor.latency_sketches(log.limit(0), "ts", "ms", "1 day", []).count() == 0
