"""Streaming twins: each one is checked by the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark import schemas
from modspark.catalog import flows, ordered
from modspark.catalog.common import query, table
from modspark.functions import text as T
from modspark.functions.maths import epoch_millis, epoch_seconds
from modspark.operators import tables
from modspark.session import scratch_path
from modspark.sources import sinks
from modspark.streaming import event_time, jobs, merging

c = F.col


def _stream(s, d, name):
    return jobs.stream_of(s, f"{d}/{name}.parquet", table(s, d, name).schema)


def _events(s, d):
    return _stream(s, d, "events").withColumns({"sec": epoch_seconds(c("ts")), "ms": epoch_millis(c("ts"))})


@query("stream_rate_limit", ordered.RATE_SQL)
def stream_rate_limit(s, d):
    out = jobs.rate_limit_stream(_events(s, d), "user_id", "sec", "event_id", 3, 86400, idle_ms=None)
    return jobs.run_to_table(s, out, "rate").select("event_id", "user_id", "sec", "prior", "allowed")


@query("stream_history", ordered.HISTORY_SQL)
def stream_history(s, d):
    out = jobs.history_stream(_stream(s, d, "conversations"), "conv_id", "turn", "text", idle_ms=None)
    return jobs.run_to_table(s, out, "history").select(
        "conv_id", "turn", F.size("history").alias("n"), F.array_join("history", "\n").alias("history")
    )


@query("stream_duplicates", ordered.DUPLICATES_SQL)
def stream_duplicates(s, d):
    out = jobs.duplicates_stream(
        _events(s, d), ["user_id", "event_type"], "ms", "event_id", ordered.GAP_MS, idle_ms=None
    )
    return jobs.run_to_table(s, out, "duplicates").select("event_id", "user_id", "event_type", "ms")


@query("stream_context_scores", flows.CONTEXT_SQL)
def stream_context_scores(s, d):
    out = jobs.conversation_stream(_stream(s, d, "conversations"), "conv_id", "turn", idle_ms=None)
    return jobs.run_to_table(s, flows.context_rows(out), "context_scores")


@query("stream_assembled", ordered.ASSEMBLED_SQL)
def stream_assembled(s, d):
    """Chunks dealt over several files, so that a message's come in several micro-batches and out of order."""
    pieces = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), T.word_chunks(c("text")).alias("pieces"))
    chunks = pieces.select("id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "chunk"))
    chunks = chunks.select("id", "seq", "chunk", (c("seq") == c("n") - 1).alias("last"))
    path = scratch_path(s, "chunks")
    chunks.repartitionByRange(5, F.pmod(F.xxhash64("id", "seq"), F.lit(5))).write.parquet(path)
    out = jobs.assembled_stream(jobs.stream_of(s, path, chunks.schema, files=1), "id", "seq", "chunk", "last")
    rows = jobs.run_to_table(s, out, "assembled")
    measures = {"chunks": F.sum("chunks"), "done": F.max(c("status") == jobs.DONE)}
    whole = tables.assemble_chunks(rows, "id", "start", "text", "suggestion", measures).where("done")
    name = F.split("id", "-")
    return whole.select(name[0].cast("long").alias("conv_id"), name[1].cast("long").alias("turn"), "suggestion", "chunks")


def _parsed(s, d):
    return jobs.dead_letters(flows.frames(_stream(s, d, "conversations")), "frame")


@query("stream_moderation", flows.MODERATED_SQL)
def stream_moderation(s, d):
    out = flows.scored_messages(flows.good_messages(_parsed(s, d))).select(
        "message_id", "channel_id", c("overall_score").alias("overall"), "severity", "status", "model_version"
    )
    return jobs.run_to_table(s, out, "moderation")


@query("stream_delivered", flows.DELIVERED_SQL)
def stream_delivered(s, d):
    moderated = flows.scored_messages(flows.good_messages(_parsed(s, d))).select(
        "message_id", "channel_id", "text", "status"
    )
    base = scratch_path(s, "delivered")
    jobs.write_delivered(moderated, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return s.read.schema(moderated.schema).parquet(f"{base}/out").select("message_id", "channel_id", "text")


@query("stream_dead_letters", flows.ERRORS_SQL)
def stream_dead_letters(s, d):
    bad = _parsed(s, d).filter(c("reason").isNotNull()).select("conv_id", "turn", "reason")
    return jobs.run_to_table(s, bad, "errors")


@query("stream_feedback_triggers", "SELECT count(*) // 500 AS fires, count(*) % 500 AS carry, count(*) AS n FROM events")
def stream_feedback_triggers(s, d):
    base = scratch_path(s, "feedback")
    jobs.feedback_triggers(_stream(s, d, "events"), f"{base}/counter", f"{base}/checkpoint").awaitTermination()
    rows = s.read.schema("batch_id long, n long, fires long, carry long").parquet(f"{base}/counter")
    return rows.agg(F.sum("fires").alias("fires"), F.max_by("carry", "batch_id").alias("carry"), F.sum("n").alias("n"))


@query("stream_latest_status", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def stream_latest_status(s, d):
    updates = _stream(s, d, "events").select("user_id", "event_id", c("event_type").alias("status"))
    base = scratch_path(s, "status")
    jobs.upsert_status(updates, f"{base}/table", f"{base}/checkpoint", "user_id", "event_id", ["status"]).awaitTermination()
    return jobs.latest_status(s, f"{base}/table", updates.schema, "user_id", "event_id", ["status"])


def _in_files(s, rows, part, n):
    """Rows as a stream that takes one file a micro-batch, in the order of ``part`` (0 to n - 1)."""
    path = scratch_path(s, "arrivals")
    for i in range(n):
        rows.where(part == i).repartition(1).write.mode("append").parquet(path)
    return jobs.stream_of(s, path, rows.schema, files=1)


def _out_of_order(s, d):
    """Events in four files by time, up to an hour out of order, then every 97th, then a row that moves the clock."""
    events = ordered.events_with_time(s, d).select("event_id", "user_id", "event_type", "ms")
    ends = events.agg(F.struct(F.min("ms").alias("lo"), F.max("ms").alias("hi"))).scalar()
    arrival = c("ms") + F.pmod(F.xxhash64("event_id"), F.lit(ordered.DELAY_MS - 1000))
    quarter = F.least(F.floor((arrival - ends["lo"]) * 4 / (ends["hi"] - ends["lo"] + 1)), F.lit(3))
    part = F.when(c("event_id") % 97 == 0, 4).otherwise(quarter)
    none = F.lit(None)
    clock = events.agg((F.max("ms") + 40 * 86_400_000).alias("ms")).select(
        F.lit(-1).cast("long").alias("event_id"), none.cast(events.schema["user_id"].dataType).alias("user_id"), none.cast("string").alias("event_type"), "ms", F.lit(5).alias("part")
    )
    rows = events.withColumn("part", part.cast("int")).unionByName(clock).withColumn("at", F.timestamp_millis("ms"))
    return _in_files(s, rows, c("part"), 6)


@query("stream_rate_by_time", ordered.RATE_BY_TIME_SQL)
def stream_rate_by_time(s, d):
    out = event_time.rate_limit_by_time(_out_of_order(s, d), "user_id", "at", "event_id", 3, 86400, ordered.DELAY_MS)
    rows = jobs.run_to_table(s, out, "rate-by-time").where("event_id >= 0")
    return rows.select("event_id", "user_id", F.floor(c("at_ms") / 1000).alias("sec"), "prior", (c("allowed") == 1).alias("allowed"), "status")


@query("stream_duplicates_by_time", ordered.DUPLICATES_BY_TIME_SQL)
def stream_duplicates_by_time(s, d):
    out = event_time.duplicates_by_time(_out_of_order(s, d), ["user_id", "event_type"], "at", "event_id", ordered.GAP_MS, ordered.DELAY_MS)
    rows = jobs.run_to_table(s, out, "duplicates-by-time").where("event_id >= 0 and (kept = 1 or status = 'late')")
    return rows.select("event_id", "user_id", "event_type", c("at_ms").alias("ms"), "status")


@query("stream_status_maps", ordered.LATEST_SQL)
def stream_status_maps(s, d):
    """Updates in three micro-batches, out of order; the table is compacted and a second stream goes on."""
    updates = ordered.status_updates(table(s, d, "events"))
    deal = F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int")
    base = scratch_path(s, "maps")
    maps = merging.StatusMaps(s, f"{base}/table", updates.schema, "user_id", "event_id", "status", "moderation")
    maps.follow(_in_files(s, updates.where(deal < 3), deal, 3), f"{base}/first").awaitTermination()
    maps.compact()
    maps.follow(_in_files(s, updates.where(deal == 3), deal - 3, 1), f"{base}/second").awaitTermination()
    return ordered.status_rows(maps.read())


def _flagged(batch, params):
    cut = params.where("tag = 'toxic'").agg(F.max("threshold")).scalar()
    scored = flows.scored_messages(batch).select("message_id", c("scores")[0].alias("score"))
    return scored.withColumn("flagged", c("score") >= cut)


@query(
    "stream_param_swap",
    f"""WITH {flows._MESSAGES} SELECT message_id, s0 AS score, s0 >= CASE WHEN doc_id // 100 % 2 = 0 THEN 0.5 ELSE 0.2 END AS flagged FROM m JOIN scored USING (doc_id)""",
)
def stream_param_swap(s, d):
    """A newer threshold arrives between two micro-batches of one stream."""
    messages = flows.good_messages(flows.readers.parse_frames(flows.frames(table(s, d, "conversations")), "frame"))
    messages = messages.withColumn("part", (F.floor(c("doc_id") / 100) % 2).cast("int"))
    source, base, params = scratch_path(s, "messages"), scratch_path(s, "swap"), scratch_path(s, "thresholds")
    for part, (run, cut) in enumerate([("2024-12-31", 0.5), ("2025-01-05", 0.2)]):
        sinks.write_params(s.createDataFrame([("toxic", cut)], schemas.THRESHOLD), params, run)
        messages.where(c("part") == part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_of(s, source, messages.schema, files=1)
        merging.with_newest_params(stream, params, schemas.THRESHOLD, _flagged, base, f"{base}/checkpoint").awaitTermination()
    return s.read.parquet(f"{base}/out").select("message_id", "score", "flagged")
