"""Explicit schemas of every source; nothing is inferred at read time."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from modspark.constants import LABELS

_label_fields = [StructField(t, IntegerType()) for t in LABELS]

CORPUS = StructType([StructField("text", StringType()), StructField("source_language", StringType()), *_label_fields])
SOURCE_COMMENTS = StructType([StructField("comment_text", StringType()), *_label_fields])
SOURCE_BINARY = StructType(
    [StructField("text", StringType()), StructField("label", IntegerType()), StructField("lang", StringType())]
)
SOURCE_CLASSED = StructType(
    [
        StructField("cleaned Tweets", StringType()),
        StructField("rawtweets", StringType()),
        StructField("binary class", StringType()),
        StructField("Context class", StringType()),
    ]
)
PAIRS = StructType([StructField("toxic_text", StringType()), StructField("clean_text", StringType())])
ENSEMBLE_CORPUS = StructType(
    [
        StructField("Sentence", StringType()),
        StructField("binary_toxicity", IntegerType()),
        *_label_fields,
        StructField("Toxicity Level", IntegerType()),
    ]
)
FRAME = StructType(
    [
        StructField("type", StringType()),
        StructField("text", StringType()),
        StructField("channel_id", StringType()),
        StructField("user_id", StringType()),
        StructField("skip_moderation", BooleanType()),
    ]
)
MODERATION = StructType(
    [
        StructField("is_toxic", BooleanType()),
        StructField("overall_score", DoubleType()),
        StructField("severity", StringType()),
        StructField("categories", MapType(StringType(), DoubleType())),
        StructField("detected_language", StringType()),
        StructField("suggestion", StringType()),
        StructField("model_version", StringType()),
        StructField("inference_time_ms", IntegerType()),
    ]
)
MESSAGE = StructType(
    [
        StructField("message_id", StringType()),
        StructField("channel_id", StringType()),
        StructField("sender_id", StringType()),
        StructField("sender_name", StringType()),
        StructField("content", StringType()),
        StructField("status", StringType()),
        StructField("moderation", MODERATION),
        StructField("context_snapshot", ArrayType(StringType())),
        StructField("created_at", TimestampType()),
    ]
)
FEEDBACK = StructType(
    [
        StructField("message_id", StringType()),
        StructField("moderator_id", StringType()),
        StructField("model_prediction_was_correct", BooleanType()),
        StructField("correct_label", StringType()),
        StructField("correct_severity", StringType()),
        StructField("notes", StringType()),
        StructField("submitted_at", TimestampType()),
    ]
)
PREDICTION = StructType(
    [
        StructField("row_id", LongType()),
        StructField("split", StringType()),
        StructField("model", StringType()),
        StructField("tag", StringType()),
        StructField("y", IntegerType()),
        StructField("score", DoubleType()),
    ]
)
THRESHOLD = StructType([StructField("tag", StringType()), StructField("threshold", DoubleType())])
WEIGHT = StructType([StructField("tag", StringType()), StructField("weight", DoubleType())])
