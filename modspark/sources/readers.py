"""Typed readers and frame parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from modspark import constants as k
from modspark import schemas
from modspark.functions.text import strip
from modspark.operators.profile import class_weights

HISTORY_MAX = 200
MESSAGE_TYPES = ("message", "safe_message")


def read_csv(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] = ()) -> DataFrame:
    """Header CSV with quoted line breaks.  Fields are matched by position, so the
    header is checked against the schema.  A narrower select prunes the parse."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: StructType = schemas.PAIRS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_with_fallback(
    primary: Callable[[], DataFrame],
    backup: DataFrame,
    include: str,
    exclude: str | None = None,
    column: str = "source_language",
) -> DataFrame:
    """The primary source, or the matching rows of the unified backup table.

    Falls back when the primary cannot be resolved (missing path or columns).  Patterns
    are case-insensitive; a null language matches nothing.
    """
    try:
        return primary()
    except AnalysisException:
        kept = backup.filter(F.coalesce(F.col(column).rlike(f"(?i){include}"), F.lit(False)))
        if exclude:
            kept = kept.filter(~F.coalesce(F.col(column).rlike(f"(?i){exclude}"), F.lit(False)))
        return kept.select("text", column, *k.LABELS)


def seed_rows(spark: SparkSession, rows: Sequence[tuple[str, Sequence[int], str]]) -> DataFrame:
    """``(text, six labels, language)`` rows in the unified schema, tagged as curated."""
    flat = [(text, f"{lang} (curated)", *labels) for text, labels, lang in rows]
    return spark.createDataFrame(flat, schemas.CORPUS)


def read_long_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def latest_params(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the newest run of a parameter table, without its run id and version.

    The largest ``version`` is newest, of equal ones the larger id. Runs that were written without a version count by
    their id, a date (with or without a time) or its only number (``sinks.run_version``); an id without such an
    order is an error. A table without runs is returned whole.
    """
    df = _param_runs(spark, path, schema)
    newest = df.agg(_newest_run()).scalar()
    return df.filter(F.col("run_id").eqNullSafe(newest)).drop("run_id", "version")


def newest_run(spark: SparkSession, path: str) -> str | None:
    """The id of the newest run by the same order; None where there is none."""
    try:
        return _param_runs(spark, path, StructType()).agg(_newest_run().alias("run")).first()["run"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def params_of_run(spark: SparkSession, path: str, schema: StructType, run_id: str | None) -> DataFrame:
    """Rows of one run, none for a null id."""
    if run_id is None:
        return spark.createDataFrame([], schema)
    return _param_runs(spark, path, schema).filter(F.col("run_id") == run_id).drop("run_id", "version")


def _param_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    given = [f for f in schema.fields if f.name not in ("run_id", "version")]
    stored = StructType([*given, StructField("version", LongType()), StructField("run_id", StringType())])
    return spark.read.schema(stored).json(path)


def _newest_run() -> Column:
    day = r"^\D*(\d{4})-(\d\d)-(\d\d)(?:[T_ ](\d\d):?(\d\d)(?::?(\d\d))?)?\D*$"
    digits = F.concat(*(F.regexp_extract("run_id", day, i) for i in range(1, 7)))
    number = r"^\D*(\d{1,18})\D*$"
    place = (
        F.when(F.col("version").isNotNull(), F.col("version"))
        .when(F.col("run_id").rlike(day), F.rpad(digits, 14, "0").cast("long"))
        .when(F.col("run_id").rlike(number), F.regexp_extract("run_id", number, 1).cast("long"))
        .when(F.col("run_id").isNotNull(), F.raise_error(F.concat(F.lit("run id without an order: "), "run_id")).cast("long"))
    )
    run = F.struct(place.alias("place"), "run_id")
    return F.max(F.when(F.col("run_id").isNotNull(), run))["run_id"]


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Threshold of every label in the newest run; a label without one gets the default."""
    given = latest_params(spark, path, schemas.THRESHOLD)
    tags = spark.createDataFrame([(i, t) for i, t in enumerate(k.LABELS)], "pos int, tag string")
    known = given.filter(F.col("tag").isin(k.LABELS)).groupBy("tag").agg(F.max("threshold").alias("threshold"))
    return tags.join(known, "tag", "left").select(
        "tag", F.coalesce("threshold", F.lit(k.DEFAULT_TAG_THRESHOLD)).alias("threshold")
    )


def load_weights(
    spark: SparkSession, path: str, corpus: DataFrame, tags: Sequence[str], cap: float = 25.0
) -> DataFrame:
    """Class weights of the newest stored run, computed from the corpus where there is none."""
    try:
        return latest_params(spark, path, schemas.WEIGHT)
    except AnalysisException:
        return class_weights(corpus, tags, cap).select("tag", "weight")


def read_report(spark: SparkSession, path: str, results: StructType, summary: StructType) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of a document that ``sinks.report_document`` made, read line by line."""
    lines = spark.read.text(path)
    head = F.regexp_extract("value", r'^\{"summary": (.*), "results": \[$', 1)
    body = lines.where(F.col("value").rlike(r"^,?\{") & (head == ""))
    rows = body.select(F.from_json(F.ltrim("value", F.lit(",")), results).alias("r")).select("r.*")
    return rows, lines.where(head != "").select(F.from_json(head, summary).alias("r")).select("r.*")


def payload_text(payload: Column, names: Sequence[str] = ("text", "message", "content", "prompt")) -> Column:
    """First non-empty of several JSON fields, null when there is none."""
    return F.coalesce(
        *[F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names]
    )


def parse_frames(df: DataFrame, raw: str, types: Sequence[str] = MESSAGE_TYPES) -> DataFrame:
    """Adds the parsed fields and ``reason`` (null for a good frame).

    Works on batch and streaming input; ``split_frames`` routes the two sides.
    """
    schema = StructType([*schemas.FRAME.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json(
        F.col(raw), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    out = df.withColumn("_f", parsed)
    f = F.col("_f")
    reason = (
        F.when(f.isNull() | f["_corrupt"].isNotNull(), "malformed_json")
        .when(~F.coalesce(f["type"].isin(list(types)), F.lit(False)), "unknown_type")
        .when(F.coalesce(strip(f["text"]), F.lit("")) == "", "empty_text")
    )
    return out.select(
        *df.columns, *[f[c.name].alias(c.name) for c in schemas.FRAME.fields], reason.alias("reason")
    )


def split_frames(parsed: DataFrame, silent_types: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good frames, error frames).  ``silent_types`` drops unknown types as the
    gateway does instead of reporting them."""
    good = parsed.filter(F.col("reason").isNull()).drop("reason")
    bad = parsed.filter(F.col("reason").isNotNull())
    if silent_types:
        bad = bad.filter(F.col("reason") == "malformed_json")
    return good, bad


def message_documents(df: DataFrame) -> DataFrame:
    """Drop the store's internal id and publish ``message_id`` as ``id`` when absent."""
    out = df.drop("_id")
    return out if "id" in out.columns else out.withColumn("id", F.col("message_id"))


def channel_history(
    messages: DataFrame, channel: Column | str, limit: int = 50, newest: bool = False, tie: str = "message_id"
) -> DataFrame:
    """The first ``limit`` messages of a channel by time (the last ones with ``newest``).

    A limit outside 1 to 200 is an error, as it is for the service.
    """
    if not 1 <= limit <= HISTORY_MAX:
        raise ValueError(f"limit must be from 1 to {HISTORY_MAX}, not {limit}")
    order = [F.desc("created_at"), F.desc(tie)] if newest else [F.asc("created_at"), F.asc(tie)]
    return messages.filter(F.col("channel_id") == channel).orderBy(*order).limit(limit)
