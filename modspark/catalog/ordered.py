"""Rate limit, history, duplicates, message order."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark.catalog.common import SECONDS_SQL, query, table
from modspark.functions import text as T
from modspark.functions.maths import epoch_millis, epoch_seconds
from modspark.operators import tables
from modspark.operators import windows as W
from modspark.session import spread
from modspark.sources import readers

c = F.col


def events_with_time(s, d):
    ev = table(s, d, "events")
    return ev.withColumns({"sec": epoch_seconds(c("ts")), "ms": epoch_millis(c("ts"))})


RATE_SQL = f"""WITH e AS (SELECT event_id, user_id, {SECONDS_SQL} AS sec FROM events),
  p AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING)
    + row_number() OVER (PARTITION BY user_id, sec ORDER BY event_id) - 1 AS prior FROM e)
  SELECT event_id, user_id, sec, prior::BIGINT AS prior, prior < 3 AS allowed FROM p"""


@query("rate_limit", RATE_SQL)
def rate_limit(s, d):
    out = W.rate_limit(events_with_time(s, d), "user_id", "sec", "event_id", 3, 86400)
    return out.select("event_id", "user_id", "sec", "prior", "allowed")


_HIST = "list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
HISTORY_SQL = f"""SELECT conv_id, turn, len(coalesce(h, []))::INTEGER AS n, coalesce(array_to_string(h, chr(10)), '') AS history
  FROM (SELECT conv_id, turn, {_HIST} AS h FROM conversations)"""


def _history(s, d):
    return W.history(table(s, d, "conversations"), "conv_id", "turn", "text")


@query("history_last5", HISTORY_SQL)
def history_last5(s, d):
    return _history(s, d).select(
        "conv_id", "turn", F.size("history").alias("n"), F.array_join("history", "\n").alias("history")
    )


@query(
    "context_last4",
    f"""WITH h AS (SELECT conv_id, turn, text, {_HIST} AS h FROM conversations),
    x AS (SELECT *, CASE WHEN len(h) > 0 THEN array_to_string(list_reverse(list_reverse(h)[1:4]), ' ') END AS context FROM h)
    SELECT conv_id, turn, context, CASE WHEN coalesce(context, '') <> '' THEN context ELSE text END AS segment_a,
      CASE WHEN coalesce(context, '') <> '' THEN text END AS segment_b FROM x""",
)
def context_last4(s, d):
    return _history(s, d).select(
        "conv_id",
        "turn",
        W.context_string(c("history")).alias("context"),
        W.segments(c("history"), c("text")).alias("s"),
    ).select("conv_id", "turn", "context", "s.segment_a", "s.segment_b")


@query(
    "packed_context",
    """WITH h AS (SELECT conv_id, turn, role, text, coalesce(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)
    SELECT conv_id, turn, array_to_string(list_concat(['[COMMUNITY=general]', '[USER=' || role || ']'],
      list_transform(h, lambda x, i: '[TURN-' || (len(h) - i + 1) || '] ' || x), ['[CURRENT] ' || role || ': ' || text]), chr(10)) AS packed FROM h""",
)
def packed_context(s, d):
    turns = table(s, d, "conversations").withColumn("pair", F.struct("role", "text"))
    h = W.history(turns, "conv_id", "turn", "pair", keep=3)
    part = lambda name: F.transform("history", lambda x: x[name])
    return h.select(
        "conv_id",
        "turn",
        W.packed_context(F.lit("general"), c("role"), part("text"), part("role"), c("text"), c("role")).alias("packed"),
    )


@query(
    "multi_turn_training",
    """SELECT conv_id, turn, text, len(h)::INTEGER AS n_context, array_to_string(h, ' | ') AS context
    FROM (SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM conversations) WHERE len(h) >= 3""",
)
def multi_turn_training(s, d):
    h = _history(s, d).filter(F.size("history") >= 3)
    return h.select(
        "conv_id", "turn", "text", F.size("history").alias("n_context"), F.array_join("history", " | ").alias("context")
    )


GAP_MS = 6 * 3600 * 1000

MILLIS_SQL = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"
# The chain of kept arrivals per key, followed one kept row at a time.
_CHAIN_SQL = f"""e AS (SELECT user_id, event_type, {MILLIS_SQL} AS ms, min(event_id) AS event_id FROM {{source}} GROUP BY ALL),
  nxt AS (SELECT a.user_id, a.event_type, a.ms, a.event_id, b.ms AS to_ms FROM (SELECT *, ms + {GAP_MS} AS free FROM e) a
    ASOF LEFT JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.free <= b.ms),
  k AS (SELECT n.* FROM nxt n JOIN (SELECT user_id, event_type, min(ms) AS ms FROM e GROUP BY ALL) f USING (user_id, event_type, ms)
    UNION ALL SELECT n.* FROM k JOIN nxt n ON n.user_id = k.user_id AND n.event_type = k.event_type AND n.ms = k.to_ms)"""
DUPLICATES_SQL = f"WITH RECURSIVE {_CHAIN_SQL.format(source='events')} SELECT event_id, user_id, event_type, ms FROM k"

# Events as a stream delivers them: every 97th after all others, late if its place was closed by then.
DELAY_MS = 3_600_000
_LATE_SQL = f"SELECT *, event_id % 97 = 0 AND {{closes}} <= (SELECT max({MILLIS_SQL}) FROM events WHERE event_id % 97 <> 0) - {DELAY_MS} AS late FROM events"
RATE_BY_TIME_SQL = f"""WITH t AS ({_LATE_SQL.format(closes=f'({SECONDS_SQL} + 1) * 1000')}), e AS (SELECT event_id, user_id, late, {SECONDS_SQL} AS sec FROM t),
  p AS (SELECT event_id, user_id, sec, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING)
    + row_number() OVER (PARTITION BY user_id, sec ORDER BY event_id) - 1 AS prior FROM e WHERE NOT late)
  SELECT event_id, user_id, sec, prior::BIGINT AS prior, prior < 3 AS allowed, 'decided' AS status FROM p UNION ALL SELECT event_id, user_id, sec, NULL, NULL, 'late' FROM e WHERE late"""
DUPLICATES_BY_TIME_SQL = f"""WITH RECURSIVE t AS ({_LATE_SQL.format(closes=f'{MILLIS_SQL} + 1')}), {_CHAIN_SQL.format(source='t WHERE NOT late')}
  SELECT event_id, user_id, event_type, ms, 'decided' AS status FROM k UNION ALL SELECT event_id, user_id, event_type, {MILLIS_SQL}, 'late' FROM t WHERE late"""


@query("near_duplicate_messages", DUPLICATES_SQL)
def near_duplicate_messages(s, d):
    kept = W.drop_near_duplicates(events_with_time(s, d), ["user_id", "event_type"], "ms", "event_id", GAP_MS)
    return kept.select("event_id", "user_id", "event_type", "ms")


@query(
    "channel_history",
    """SELECT event_id, id, oldest FROM (
      (SELECT event_id, 'm' || event_id AS id, true AS oldest FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 50)
      UNION ALL (SELECT event_id, 'm' || event_id AS id, false AS oldest FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20))""",
)
def channel_history(s, d):
    messages = table(s, d, "events").select(
        "event_id",
        c("event_type").alias("channel_id"),
        c("ts").alias("created_at"),
        F.concat(F.lit("m"), c("event_id").cast("string")).alias("message_id"),
        F.lit("x").alias("_id"),
    )
    old = readers.channel_history(messages, "click", 50, tie="event_id")
    new = readers.channel_history(messages, "click", 20, newest=True, tie="event_id")
    docs = lambda df, flag: readers.message_documents(df).select("event_id", "id", F.lit(flag).alias("oldest"))
    return docs(old, True).unionByName(docs(new, False))


ASSEMBLED_SQL = "SELECT conv_id, turn, text AS suggestion, len(string_split(text, ' '))::BIGINT AS chunks FROM conversations"


@query("assembled_suggestions", ASSEMBLED_SQL)
def assembled_suggestions(s, d):
    said = spread(table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    chunks = said.select(
        F.struct("conv_id", "turn").alias("id"), F.posexplode(T.word_chunks(c("text"))).alias("seq", "chunk")
    )
    whole = tables.assemble_chunks(chunks, "id", "seq", "chunk", "suggestion", {"chunks": F.count(F.lit(1))})
    return whole.select("id.conv_id", "id.turn", "suggestion", "chunks")


LATEST_SQL = """WITH u AS (SELECT user_id, event_id, event_type AS status, 'k' || (event_id % 3) AS name, event_type AS v FROM events),
    m AS (SELECT user_id, name, arg_max(v, event_id) AS v FROM u GROUP BY user_id, name)
    SELECT s.user_id, s.status, e.moderation FROM (SELECT user_id, arg_max(status, event_id) AS status FROM u GROUP BY user_id) s
    JOIN (SELECT user_id, string_agg(name || '=' || v, ',' ORDER BY name) AS moderation FROM m GROUP BY user_id) e USING (user_id)"""


def status_updates(events):
    return events.select(
        "user_id",
        "event_id",
        c("event_type").alias("status"),
        F.create_map(F.concat(F.lit("k"), (c("event_id") % 3).cast("string")), "event_type").alias("moderation"),
    )


def status_rows(out):
    entries = F.transform(F.map_entries("moderation"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("user_id", "status", F.array_join(entries, ",").alias("moderation"))


@query("latest_status", LATEST_SQL)
def latest_status(s, d):
    return status_rows(tables.latest_by_id(status_updates(table(s, d, "events")), "user_id", "event_id", "status", "moderation"))
