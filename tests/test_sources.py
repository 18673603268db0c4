import json
import os

import pytest
from pyspark.sql import functions as F

from modspark import constants as k
from modspark import schemas
from modspark.operators import policy as P
from modspark.session import broadcast_if_small, scratch_path, spread
from modspark.sources import readers, sinks


def test_csv_keeps_line_breaks_quotes_and_checks_the_header(spark):
    path = scratch_path(spark, "csv")
    rows = [("a\nb, \"c\"", "en", *[0] * 6), ("नमस्ते", "hi", *[1] * 6)]
    sinks.write_csv(spark.createDataFrame(rows, schemas.CORPUS), path)
    back = readers.read_csv(spark, path, schemas.CORPUS, ["text", "toxic"])
    assert sorted(tuple(r) for r in back.collect()) == sorted([(rows[0][0], 0), (rows[1][0], 1)])
    with pytest.raises(Exception):
        readers.read_csv(spark, path, schemas.SOURCE_BINARY).count()


def test_splits_and_jsonl(spark):
    df = spark.createDataFrame([("é", "train"), ("b", "val")], "text string, split string")
    path = scratch_path(spark, "splits")
    sinks.write_splits(df, path)
    assert spark.read.parquet(path).filter("split = 'val'").count() == 1
    sinks.write_splits(df, path + "csv", "csv")
    lines = scratch_path(spark, "lines")
    sinks.write_jsonl(df, lines)
    sinks.write_jsonl(df, lines, append=True)
    texts = [r.value for r in spark.read.text(lines).collect()]
    assert len(texts) == 4 and any("é" in t for t in texts)


def test_payload_and_frames(spark):
    df = spark.createDataFrame(
        [
            (1, '{"text":"","message":"hi"}'),
            (2, '{"type":"message","text":"ok"}'),
            (3, "{broken"),
            (4, '{"type":"typing","text":"x"}'),
            (5, '{"type":"safe_message","text":"  "}'),
            (6, None),
        ],
        "id int, raw string",
    )
    assert df.select(readers.payload_text(F.col("raw"))).first()[0] == "hi"
    parsed = readers.parse_frames(df, "raw")
    good, bad = readers.split_frames(parsed)
    assert [r.id for r in good.collect()] == [2]
    assert {r.id: r.reason for r in bad.collect()} == {
        1: "unknown_type", 3: "malformed_json", 4: "unknown_type", 5: "empty_text", 6: "malformed_json",
    }
    assert readers.split_frames(parsed, silent_types=True)[1].count() == 2


def test_fallback_and_seed(spark):
    backup = readers.seed_rows(spark, [("a", [0] * 6, "english"), ("b", [1] * 6, "hinglish")])
    missing = lambda: spark.read.parquet(scratch_path(spark, "none"))
    assert [r.text for r in readers.read_with_fallback(missing, backup, "ENGLISH").collect()] == ["a"]
    assert readers.read_with_fallback(missing, backup, "hinglish", "curated").count() == 0
    assert readers.read_with_fallback(lambda: backup, backup, "x").count() == 2


def test_thresholds_default_and_versions(spark):
    path = scratch_path(spark, "thr")
    sinks.write_params(spark.createDataFrame([("toxic", 0.45)], schemas.THRESHOLD), path, "run-1")
    got = {r.tag: r.threshold for r in readers.load_thresholds(spark, path).collect()}
    assert got["toxic"] == 0.45 and got["threat"] == 0.5 and len(got) == len(k.LABELS)
    sinks.write_params(spark.createDataFrame([("toxic", 0.6)], schemas.THRESHOLD), path, "run-2")
    from pyspark.sql.types import StructType

    latest = readers.latest_params(spark, path, schemas.THRESHOLD)
    assert [r.threshold for r in latest.collect()] == [0.6]


def test_the_newest_run_by_date_number_or_version(spark):
    def newest(*runs):
        path = scratch_path(spark, "runs")
        for i, run in enumerate(runs):
            sinks.write_params(spark.createDataFrame([("toxic", i / 10)], schemas.THRESHOLD), path, *run)
        return [r.threshold for r in readers.latest_params(spark, path, schemas.THRESHOLD).collect()]

    assert newest(("2025-01-05",), ("2024-12-31",)) == [0.0]
    assert newest(("2025-01-05T09:00:00",), ("2025-01-05T10:30",), ("2025-01-05",)) == [0.1]
    assert newest(("run-10",), ("run-9",)) == [0.0]
    assert newest(("final", 1), ("draft", 2), ("run-1",)) == [0.1]
    assert newest(("b", 3), ("a", 3)) == [0.0]
    for name in ("final", "v1.2", "1-2"):
        with pytest.raises(ValueError, match="no order"):
            sinks.run_version(name)


def test_runs_of_tables_without_versions(spark):
    def stored(*runs):
        path = scratch_path(spark, "old")
        for i, run in enumerate(runs):
            spark.createDataFrame([("toxic", i / 10, run)], "tag string, threshold double, run_id string").write.mode("append").partitionBy("run_id").json(path)
        return path

    def read(path):
        return [r.threshold for r in readers.latest_params(spark, path, schemas.THRESHOLD).collect()]

    assert read(stored("2025-01-05", "2024-12-31")) == [0.0]
    assert read(stored("run-9", "run-10")) == [0.1]
    with pytest.raises(Exception, match="without an order"):
        read(stored("best", "run-1"))


def test_run_metadata_and_report_lines(spark):
    meta = sinks.run_metadata(spark.createDataFrame([(0.5, 1)], "f1 double, epoch int"), "m", ["a", "b"], 3).first()
    assert meta.tags == "a,b" and json.loads(meta.metrics) == {"f1": 0.5, "epoch": 1}
    results = spark.createDataFrame([(1, True), (2, False)], "id long, flagged boolean")
    summary = results.agg(F.count("*").alias("total"))
    path = scratch_path(spark, "report")
    sinks.write_lines(sinks.report_lines(results, summary, "id"), path, ["pos"])
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {"total": 2} in lines and {"id": 1, "flagged": True} in lines


def test_report_document_is_one_json_value(spark):
    rows = [(i, i % 3 == 0, f'a "{i}" ], }}\n{{"summary": 1') for i in range(500)]
    results = spark.createDataFrame(rows, "id long, flagged boolean, text string").repartition(7)
    summary = results.agg(F.count("*").alias("total"))
    for part in (results, results.where("id < 1"), results.limit(0)):
        path = scratch_path(spark, "report")
        sinks.write_lines(sinks.report_document(part, summary, "id"), path, ["part", "pos"])
        whole = "".join(open(f"{path}/{name}").read() for name in sorted(os.listdir(path)) if name.startswith("part-"))
        document = json.loads(whole)
        want = sorted(tuple(r) for r in part.collect())
        assert document["summary"] == {"total": 500} and [(r["id"], r["flagged"], r["text"]) for r in document["results"]] == want
        back, head = readers.read_report(spark, path, results.schema, summary.schema)
        assert sorted(map(tuple, back.collect())) == want and head.first().total == 500


def test_message_ids_are_replay_safe(spark):
    df = spark.range(3).select(sinks.message_id(F.col("id"), F.lit("x")).alias("m"))
    assert df.collect() == df.collect() and df.distinct().count() == 3


def test_channel_history_orders(spark):
    df = spark.createDataFrame([("c", f"m{i}", i) for i in range(5)], "channel_id string, message_id string, created_at int")
    assert [r.message_id for r in readers.channel_history(df, "c", 2).collect()] == ["m0", "m1"]
    assert [r.message_id for r in readers.channel_history(df, "c", 2, newest=True).collect()] == ["m4", "m3"]


def test_broadcast_only_within_the_bound(spark):
    df = spark.range(20)
    assert broadcast_if_small(df, 10) is df and broadcast_if_small(df, 20) is not df
    assert spread(df.repartition(16)).rdd.getNumPartitions() == 16
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_policy_takes_strictest_action(spark):
    long = spark.createDataFrame([(1, "t", "toxic", 0.9), (1, "t", "threat", 0.1), (2, "t", "toxic", 0.1)], "id int, tenant string, tag string, score double")
    pol = spark.createDataFrame([("t", "toxic", 0.5, "warn", "v1"), ("t", "toxic", 0.8, "block", "v1")], "tenant string, tag string, min_score double, action string, version string")
    assert {r.id: r.action for r in P.policy_actions(long, pol, "id").collect()} == {1: "block", 2: "allow"}


def test_rule_sets(spark):
    df = spark.createDataFrame([("x", "d" * 300, ["a"] * 51, "n" * 1001, [0.5, 1.5])], "name string, description string, texts array<string>, notes string, scores array<double>")
    rules = {**P.channel_rules(), **P.batch_rules(), **P.feedback_rules(), **P.score_rules(), **P.user_rules("name")}
    assert df.select(P.violations(rules)).first()[0] == [
        "name_length", "description_length", "batch_size", "notes_too_long", "score_range", "display_name_length",
    ]
