"""Writers.  Large tables are partitioned Parquet; CSV and JSON are exchange formats."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; Spark keeps non-ASCII characters as they are."""
    df.write.mode("append" if append else "overwrite").json(path)


def run_version(run_id: str) -> int:
    """The place of a run among others, from an id with one number (``run-10``) or a date with or without a time
    (``2025-01-05``, ``2025-01-05T10:30:00``). Another id says nothing about order and is refused."""
    day = re.fullmatch(r"\D*(\d{4})-(\d\d)-(\d\d)(?:[T_ ](\d\d):?(\d\d)(?::?(\d\d))?)?\D*", run_id)
    if day:
        return int("".join(x or "00" for x in day.groups()))
    number = re.fullmatch(r"\D*(\d{1,18})\D*", run_id)
    if number:
        return int(number[1])
    raise ValueError(f"run id {run_id!r} has no order; give a version")


def write_params(df: DataFrame, path: str, run_id: str, version: int | None = None) -> None:
    """Small parameter tables, one folder per run so earlier versions stay readable.

    ``version`` says which run is newest; it is taken from the id where that has an order.
    """
    place = run_version(run_id) if version is None else version
    rows = df.withColumn("version", F.lit(place).cast("long")).withColumn("run_id", F.lit(run_id))
    rows.write.mode("append").partitionBy("run_id").json(path)


def run_metadata(metrics: DataFrame, model: str, tags: Sequence[str], epochs: int) -> DataFrame:
    """One metadata row per metrics row."""
    return metrics.select(
        F.lit(model).alias("model"),
        F.lit(",".join(tags)).alias("tags"),
        F.lit(epochs).alias("epochs"),
        F.to_json(F.struct(*metrics.columns)).alias("metrics"),
    )


def message_id(*parts: Column) -> Column:
    """Deterministic id, so a replayed batch writes the same ids."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)


def stored_messages(df: DataFrame) -> DataFrame:
    """Nested document of a moderated message."""
    return df.select(
        "message_id",
        "channel_id",
        F.col("user_id").alias("sender_id"),
        F.coalesce("sender_name", "user_id").alias("sender_name"),
        F.col("text").alias("content"),
        "status",
        F.struct(
            "is_toxic",
            "overall_score",
            "severity",
            "categories",
            "detected_language",
            "suggestion",
            "model_version",
            F.col("inference_time_ms").cast("int").alias("inference_time_ms"),
        ).alias("moderation"),
        "context_snapshot",
        "created_at",
    )


def append_messages(df: DataFrame, path: str) -> None:
    stored_messages(df).write.mode("append").parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Feedback rows stamped with the time of the write (UTC by session zone)."""
    stamped = df if "submitted_at" in df.columns else df.withColumn("submitted_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def report_lines(results: DataFrame, summary: DataFrame, order: str) -> DataFrame:
    """Scenario report as JSON lines: one summary line, then one line per result.

    A table of any size stays distributed; nothing is gathered into one document.
    """
    head = summary.select(F.lit("summary").alias("part"), F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct(*summary.columns)).alias("line"))
    rows = results.select(
        F.lit("result").alias("part"), F.col(order).cast("long").alias("pos"), F.to_json(F.struct(*results.columns)).alias("line")
    )
    return head.unionByName(rows)


def report_document(results: DataFrame, summary: DataFrame, order: str) -> DataFrame:
    """Scenario report as one JSON document ``{"summary": ..., "results": [...]}``: its lines, each with its place
    (``part``, ``pos``), for ``write_lines(..., ["part", "pos"])``.

    Files that are put together in the order of their names are the document; no task holds it whole. ``order`` has no
    nulls and no value twice: the result with the smallest one has no comma before it. ``summary`` has one row.
    """
    place = lambda part, pos: (F.lit(part).alias("part"), pos.cast("long").alias("pos"))
    head = summary.select(*place(0, F.lit(0)), F.concat(F.lit('{"summary": '), F.to_json(F.struct(*summary.columns)), F.lit(', "results": [')).alias("line"))
    first = results.agg(F.min(order)).scalar()
    comma = F.when(F.col(order) == first, "").otherwise(",")
    rows = results.select(*place(1, F.col(order)), F.concat(comma, F.to_json(F.struct(*results.columns))).alias("line"))
    tail = summary.limit(1).select(*place(2, F.lit(0)), F.lit("]}").alias("line"))
    return head.unionByName(rows).unionByName(tail)


def write_lines(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
