"""Frames, stored messages, feedback and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark import constants as k
from modspark.catalog.common import derived_scores, derived_sql, query, table
from modspark.catalog.moderation import action_sql, points_ctes, severity_sql
from modspark.catalog.texts import normalized_ctes
from modspark.functions import scores as S
from modspark.functions import text as T
from modspark.lexicon import HALF_POINT
from modspark.operators import feedback as FB
from modspark.operators import monitor, scoring
from modspark.plans.moderation import moderate_conversations
from modspark.session import scratch_path, spread
from modspark.sources import readers, sinks

c = F.col

# --- frames ------------------------------------------------------------------------------


def frames(conversations):
    """Conversation turns as JSON frames, some of them broken on purpose."""
    kind = c("turn") % 5
    good = F.to_json(
        F.struct(
            F.when(kind == 3, "typing").when(kind == 2, "safe_message").otherwise("message").alias("type"),
            F.when(kind == 4, "   ").otherwise(c("text")).alias("text"),
            F.concat(F.lit("room"), (c("conv_id") % 3).cast("string")).alias("channel_id"),
            c("role").alias("user_id"),
        )
    )
    broken = F.concat(F.lit('{"type": "message", "text": '), c("role"))
    return conversations.select(
        "conv_id", "turn", F.when((c("conv_id") % 7 == 0) & (kind == 1), broken).otherwise(good).alias("frame")
    )


_REASON = """CASE WHEN conv_id % 7 = 0 AND turn % 5 = 1 THEN 'malformed_json' WHEN turn % 5 = 3 THEN 'unknown_type'
    WHEN turn % 5 = 4 OR trim(text) = '' THEN 'empty_text' END"""
ERRORS_SQL = f"SELECT conv_id, turn, {_REASON} AS reason FROM conversations WHERE {_REASON} IS NOT NULL"


@query("message_errors", ERRORS_SQL)
def message_errors(s, d):
    _, bad = readers.split_frames(readers.parse_frames(frames(table(s, d, "conversations")), "frame"))
    return bad.select("conv_id", "turn", "reason")


def good_messages(raw):
    good, _ = readers.split_frames(raw)
    return good.select(
        (c("conv_id") * 100 + c("turn")).alias("doc_id"),
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        "channel_id",
        "user_id",
        "type",
        "text",
    )


def scored_messages(messages):
    """Lower-cased lexicon scores with the bypass of approved texts; stateless."""
    skip = c("type") == "safe_message"
    normal = messages.withColumn("normalized", F.when(~skip, F.lower("text")).otherwise(""))
    out = scoring.moderated(scoring.lexicon_scorer()(normal))
    return out.withColumn("model_version", F.when(skip, k.BYPASS_VERSION).otherwise(k.LEXICON_VERSION))


_MESSAGES = f"""m AS (SELECT conv_id * 100 + turn AS doc_id, conv_id || '-' || turn AS message_id, 'room' || (conv_id % 3) AS channel_id, role AS user_id, text,
    turn % 5 = 2 AS skip FROM conversations WHERE {_REASON} IS NULL), low AS (SELECT doc_id, CASE WHEN skip THEN '' ELSE lower(text) END AS t FROM m),
  {points_ctes('low')}, o AS (SELECT doc_id, greatest(s0, s1, s2, s3, s4, s5) AS overall FROM scored),
  r AS (SELECT m.*, overall, {severity_sql('overall')} AS severity, CASE WHEN skip THEN 'bypass' ELSE 'lexicon-1' END AS model_version FROM m JOIN o USING (doc_id))"""
MODERATED_SQL = f"WITH {_MESSAGES} SELECT message_id, channel_id, overall, severity, {action_sql('severity')} AS status, model_version FROM r"
DELIVERED_SQL = f"WITH {_MESSAGES} SELECT message_id, channel_id, text FROM r WHERE {action_sql('severity')} = 'DELIVERED'"


@query(
    "message_store",
    f"""WITH {_MESSAGES} SELECT 'fb-' || substr(message_id, 1, 8) AS feedback_id, message_id AS id, channel_id, user_id AS sender_id, user_id AS sender_name, text AS content,
      {action_sql('severity')} AS status, overall AS overall_score, severity, model_version FROM r""",
)
def message_store(s, d):
    parsed = readers.parse_frames(frames(spread(table(s, d, "conversations"), "conv_id", "turn")), "frame")
    moderated = scored_messages(good_messages(parsed))
    documents = moderated.select(
        "message_id", "channel_id", "user_id", "text", "status", "is_toxic", "overall_score", "severity", "categories",
        "model_version",
        F.lit(None).cast("string").alias("sender_name"),
        F.lit("en").alias("detected_language"),
        F.lit(None).cast("string").alias("suggestion"),
        F.lit(0).alias("inference_time_ms"),
        F.array().cast("array<string>").alias("context_snapshot"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    path = scratch_path(s, "messages")
    sinks.append_messages(documents, path)
    stored = readers.message_documents(s.read.schema(sinks.stored_messages(documents).schema).parquet(path))
    return stored.select(
        FB.feedback_id(c("message_id")).alias("feedback_id"),
        "id", "channel_id", "sender_id", "sender_name", "content", "status",
        c("moderation.overall_score").alias("overall_score"),
        c("moderation.severity").alias("severity"),
        c("moderation.model_version").alias("model_version"),
    )


@query(
    "payload_coalesce",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'from message' WHEN 2 THEN 'prompt ' || user_id END AS text,
      CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def payload_coalesce(s, d):
    kind = c("event_id") % 4
    none = F.lit(None).cast("string")
    payload = F.to_json(
        F.struct(
            F.when(kind == 0, c("event_type")).when(kind == 1, "").otherwise(none).alias("text"),
            F.when(kind == 1, "from message").otherwise(none).alias("message"),
            F.when(kind == 3, "").otherwise(none).alias("content"),
            F.when(kind == 2, F.concat(F.lit("prompt "), c("user_id").cast("string"))).otherwise(none).alias("prompt"),
        )
    )
    return table(s, d, "events").select(
        "event_id",
        readers.payload_text(payload).alias("text"),
        F.from_json("props", "k long")["k"].alias("k"),
    )


# --- feedback ----------------------------------------------------------------------------


def feedback(s, d):
    """Events as feedback: an error event is an incorrect prediction."""
    return table(s, d, "events").select(
        "event_id",
        F.concat(F.lit("m"), c("event_id").cast("string")).alias("message_id"),
        c("user_id").cast("string").alias("moderator_id"),
        (c("event_type") != "error").alias(FB.CORRECT),
        c("ts").alias("submitted_at"),
    )


@query(
    "feedback_stats",
    """SELECT 'all' AS scope, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS correct, count(*) FILTER (WHERE event_type = 'error') AS incorrect,
      printf('%.4f', count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE)::DOUBLE AS accuracy, count(*) AS since_last_retrain, greatest(0, 500 - count(*)) AS remaining FROM events
    UNION ALL SELECT 'since', count(*), count(*) FILTER (WHERE event_type <> 'error'), count(*) FILTER (WHERE event_type = 'error'),
      printf('%.4f', count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE)::DOUBLE, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 12:00:00'),
      greatest(0, 500 - count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 12:00:00')) FROM events
    UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 500""",
)
def feedback_stats(s, d):
    fb = feedback(s, d)
    cut = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    parts = [
        FB.feedback_stats(fb).withColumn("scope", F.lit("all")),
        FB.feedback_stats(fb, cut).withColumn("scope", F.lit("since")),
        FB.feedback_stats(fb.filter(c("event_id") < 0)).withColumn("scope", F.lit("none")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "retrain_batches",
    """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) SELECT event_id, pos // 500 AS batch, (pos + 1) % 500 = 0 AS fires FROM p""",
)
def retrain_batches(s, d):
    return FB.retrain_batches(feedback(s, d), "event_id").select("event_id", "batch", "fires")


@query(
    "retrain_export",
    """SELECT 'm' || event_id AS message_id, CAST(user_id AS VARCHAR) AS moderator_id, false AS model_prediction_was_correct FROM events WHERE event_type = 'error'""",
)
def retrain_export(s, d):
    """Export in two rounds; the second one leaves out what the first one wrote."""
    fb = feedback(s, d).drop("submitted_at", "event_id")
    path = scratch_path(s, "export")
    first = fb.filter(F.xxhash64("message_id") % 2 == 0)
    sinks.write_jsonl(FB.retrain_export(first), path, append=True)
    exported = s.read.schema(fb.schema).json(path)
    sinks.write_jsonl(FB.retrain_export(fb, exported), f"{path}-new", append=True)
    return exported.unionByName(s.read.schema(fb.schema).json(f"{path}-new"))


@query(
    "feedback_store",
    """SELECT event_id, 'm' || event_id AS message_id, CAST(user_id AS VARCHAR) AS moderator_id, event_type <> 'error' AS model_prediction_was_correct, true AS stamped FROM events""",
)
def feedback_store(s, d):
    """Feedback appended in two batches: one is stamped by the write, one brings its time."""
    fb = feedback(s, d).withColumn("submitted_at", c("submitted_at").cast("timestamp"))
    own = F.xxhash64("event_id") % 2 == 0
    path = scratch_path(s, "feedback")
    sinks.append_feedback(fb.where(own), path)
    sinks.append_feedback(fb.where(~own).drop("submitted_at"), path)
    stored = s.read.schema(fb.schema).parquet(path).join(fb.select("event_id", c("submitted_at").alias("given")), "event_id")
    now = F.current_timestamp()
    stamped = F.when(own, c("submitted_at") == c("given")).otherwise(c("submitted_at").between(now - F.expr("INTERVAL 1 HOUR"), now))
    return stored.select("event_id", "message_id", "moderator_id", FB.CORRECT, stamped.alias("stamped"))


@query(
    "override_rate",
    f"""WITH j AS (SELECT e.event_type AS label, e.event_type <> 'error' AS ok, {derived_sql('event_id')[0]} >= 0.5 AS predicted FROM events e)
    SELECT label, count(*) AS reviews, count(*) FILTER (WHERE NOT ok) AS overrides, round(count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE, 6) AS override_rate,
      count(*) FILTER (WHERE NOT ok AND predicted) AS false_positives, count(*) FILTER (WHERE predicted) AS predicted_positives FROM j GROUP BY label""",
)
def override_rate(s, d):
    messages = table(s, d, "events").select(
        F.concat(F.lit("m"), c("event_id").cast("string")).alias("message_id"),
        c("event_type").alias("label"),
        (derived_scores("event_id")[0] >= 0.5).alias("predicted"),
    )
    joined = FB.attach_messages(feedback(s, d), messages)
    return FB.override_rate(joined, "label", c("predicted"))


@query(
    "annotator_disagreement",
    """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, sum(n)::BIGINT AS annotations, arg_max(event_type, n::VARCHAR.lpad(9, '0') || event_type) AS majority, round(1 - max(n) / sum(n)::DOUBLE, 6) AS disagreement FROM n GROUP BY user_id""".replace(
        "n::VARCHAR.lpad(9, '0')", "lpad(n::VARCHAR, 9, '0')"
    ),
)
def annotator_disagreement(s, d):
    return FB.disagreement(table(s, d, "events").select("user_id", "event_type"), "user_id", "event_type").withColumnRenamed(
        "event_type", "label"
    )


# --- operations ----------------------------------------------------------------------------


@query(
    "ops_metrics",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events GROUP BY 1, 2""",
)
def ops_metrics(s, d):
    log = table(s, d, "events").select("ts", "event_type", "value")
    out = monitor.ops_metrics(log, "ts", "value", "1 day", ["event_type"])
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "event_type",
        "requests",
        F.round("p50", 6).alias("p50"),
        F.round("p95", 6).alias("p95"),
    )


@query(
    "ops_rollup",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS requests, true AS p50_within, true AS p95_within FROM events GROUP BY 1, 2""",
)
def ops_rollup(s, d):
    """Percentiles of days from sketches of minutes and hours, held against the ranks of all rows."""
    log = table(s, d, "events").select("ts", "event_type", "value")
    minutes = monitor.latency_sketches(log, "ts", "value", "1 minute", ["event_type"])
    days = monitor.roll_up(monitor.roll_up(minutes, "1 hour", ["event_type"]), "1 day", ["event_type"])
    found = monitor.sketched_percentiles(days, {"p50": 0.5, "p95": 0.95})
    rows = log.withColumn("window_start", F.date_trunc("day", "ts")).drop("ts").join(found, ["window_start", "event_type"])

    def within(name, share):
        below, upto = F.avg((c("value") < c(name)).cast("int")), F.avg((c("value") <= c(name)).cast("int"))
        return ((below <= share + monitor.RANK_ERROR) & (upto >= share - monitor.RANK_ERROR)).alias(f"{name}_within")

    out = rows.groupBy("window_start", "event_type").agg(F.max("requests").alias("requests"), within("p50", 0.5), within("p95", 0.95))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "requests", "p50_within", "p95_within")


@query(
    "ops_counts",
    f"""WITH l AS (SELECT lang, {action_sql(severity_sql(derived_sql('doc_id')[0]))} AS action, 'v' || (doc_id % 2) AS model_version FROM documents)
    SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM l GROUP BY lang UNION ALL SELECT 'action', action, count(*) FROM l GROUP BY action
    UNION ALL SELECT 'model_version', model_version, count(*) FROM l GROUP BY model_version""",
)
def ops_counts(s, d):
    log = table(s, d, "documents").select(
        "lang",
        S.action(S.severity(derived_scores("doc_id")[0])).alias("action"),
        F.concat(F.lit("v"), (c("doc_id") % 2).cast("string")).alias("model_version"),
    )
    return monitor.count_by(log, ["lang", "action", "model_version"])


# Conversations scored after their last four turns.
_POINTS = ", ".join(f"coalesce(sum(w{i}) FILTER (doc_id % 2 = 0), 0) + coalesce(sum(w{i}) FILTER (doc_id % 2 = 1), 0)::BIGINT // 4 AS p{i}" for i in range(6))
_OWN = ", ".join(f"coalesce(sum(w{i}) FILTER (doc_id % 2 = 0), 0) AS q{i}" for i in range(6))


def _overall_sql(p: str) -> str:
    return "greatest(" + ", ".join(f"printf('%.4f', coalesce({p}{i}, 0) / (coalesce({p}{i}, 0) + {HALF_POINT})::DOUBLE)::DOUBLE" for i in range(6)) + ")"


def context_sql(source: str) -> str:
    return f"""WITH h AS (SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM {source}),
  x AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, text, lower(CASE WHEN len(h) > 0 THEN array_to_string(h, ' ') END) AS context FROM h),
  {normalized_ctes('SELECT id * 2 AS doc_id, text AS t FROM x')},
  both_ AS (SELECT doc_id, t FROM norm UNION ALL SELECT id * 2 + 1, context FROM x WHERE context IS NOT NULL),
  {points_ctes('both_')},
  joint AS (SELECT doc_id // 2 AS id, {_POINTS}, {_OWN} FROM tok JOIN lex USING (term) GROUP BY doc_id // 2),
  o AS (SELECT conv_id, turn, {_overall_sql('p')} AS overall, {_overall_sql('q')} AS alone FROM x LEFT JOIN joint USING (id))
  SELECT conv_id, turn, overall, alone, {severity_sql('overall')} AS severity, {action_sql(severity_sql('overall'))} AS status FROM o"""


CONTEXT_SQL = context_sql("conversations")


def context_rows(scored):
    alone = F.array_max(S.lexicon_scores(T.normalize_for_toxicity(c("text"))))
    return scored.select("conv_id", "turn", c("overall_score").alias("overall"), alone.alias("alone"), "severity", "status")


@query("context_scores", CONTEXT_SQL)
def context_scores(s, d):
    return context_rows(moderate_conversations(table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn"))
