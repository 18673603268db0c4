"""Structured Streaming twins of the ordered operators and the message flow.

Keyed state expires after ``idle_ms`` of processing time.  A run over all available
input (``availableNow``) passes ``idle_ms=None``: processing-time expiry asks for one more
batch without end there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from modspark import constants as k
from modspark.operators.scoring import ContextScorer, lexicon_context_scorer
from modspark.plans.moderation import score_messages
from modspark.session import scratch_path
from modspark.sources.readers import parse_frames
from modspark.streaming.event_time import BUCKETS


def moderation_stream(messages: DataFrame, skip=None, compose: bool = True) -> DataFrame:
    """Classification before any rewrite; stateless."""
    return score_messages(messages, skip=skip, compose=compose)


def conversation_stream(
    messages: DataFrame,
    conversation: str,
    turn: str,
    scorer: ContextScorer | None = None,
    turns: int = k.CONTEXT_TURNS,
    closed: str | None = None,
    idle_ms: int | None = 3_600_000,
    compose: bool = True,
) -> DataFrame:
    """Each message scored after the last ``turns`` of its conversation: keyed history feeds a context scorer in
    one query. A message enters the history whatever its verdict; a null text is an empty message."""
    said = messages.withColumn("text", F.coalesce("text", F.lit("")))
    seen = history_stream(said, conversation, turn, "text", max(turns, k.HISTORY_KEEP), closed, idle_ms, carry=True)
    # Always true; makes Spark turn rows of the keyed function into the form that the next Python function reads.
    seen = seen.where(F.size("history") >= 0)
    scorer = lexicon_context_scorer() if scorer is None else scorer
    return score_messages(seen, scorer, compose=compose, history=F.col("history"), turns=turns)


def delivered(moderated: DataFrame) -> DataFrame:
    return moderated.filter(F.col("status") == k.DELIVERED)


def write_delivered(moderated: DataFrame, path: str, checkpoint: str):
    """Delivered messages, one folder per channel."""
    return (
        delivered(moderated)
        .writeStream.format("parquet")
        .partitionBy("channel_id")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dead_letters(raw: DataFrame, column: str) -> DataFrame:
    """Every frame with its ``reason``; the sink partitions good and bad by it."""
    return parse_frames(raw, column)


def _timeout(idle_ms: int | None) -> str:
    return (
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def rate_limit_stream(
    events: DataFrame,
    user: str,
    second: str,
    tie: str,
    limit: int = k.RATE_LIMIT,
    window_s: int = k.RATE_WINDOW_S,
    idle_ms: int | None = k.RATE_IDLE_S * 1000,
) -> DataFrame:
    """Keyed rate limit: the state holds attempts per second of the last window only.

    Output: user, second, tie, prior, allowed.  Rows of a batch are ordered by second and
    tie; idle users expire by processing time. Rows without a user or a second are not limited.
    """
    out = StructType(
        [
            events.schema[user],
            StructField(second, LongType()),
            StructField(tie, LongType()),
            StructField("prior", LongType()),
            StructField("allowed", LongType()),
        ]
    )
    state_type = StructType([StructField("sec", ArrayType(LongType())), StructField("n", ArrayType(LongType()))])

    def step(key, frames, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        if pd.isna(key[0]):  # as in the batch form, rows without a user are not limited
            for pdf in frames:
                yield pd.DataFrame({user: pdf[user], second: pdf[second], tie: pdf[tie], "prior": 0, "allowed": 1})
            return
        sec, n = (np.array(v, dtype="int64") for v in state.get) if state.exists else (np.empty(0, "int64"),) * 2
        # A batch of one user is taken whole because Arrow frames of it are unordered;
        # the source's files-per-trigger or offsets-per-trigger setting bounds it.
        pdf = pd.concat(list(frames)).sort_values([second, tie])
        timeless = pdf[pdf[second].isna()]
        if len(timeless):
            yield pd.DataFrame({user: timeless[user], second: pd.array([None] * len(timeless), dtype="Int64"), tie: timeless[tie], "prior": 0, "allowed": 1})
            pdf = pdf[pdf[second].notna()]
            if not len(pdf):
                return
        t = pdf[second].to_numpy(dtype="int64")
        new_sec, first, new_n = np.unique(t, return_index=True, return_counts=True)
        all_sec = np.concatenate([sec, new_sec])
        all_n = np.concatenate([n, new_n])
        order = np.argsort(all_sec, kind="stable")
        all_sec, totals = all_sec[order], np.concatenate([[0], np.cumsum(all_n[order])])
        oldest = totals[np.searchsorted(all_sec, t - (window_s - 1), side="left")]
        # Earlier seconds, attempts of the same second from earlier batches, and the
        # position inside the second.
        carried = dict(zip(sec.tolist(), n.tolist()))
        below = totals[np.searchsorted(all_sec, t, side="left")]
        same = np.array([carried.get(int(s), 0) for s in t], dtype="int64")
        position = np.arange(len(t)) - first[np.searchsorted(new_sec, t)]
        prior = below - oldest + same + position
        horizon = int(all_sec.max()) - (window_s - 1)
        keep = all_sec >= horizon
        kept_sec, head = np.unique(all_sec[keep], return_index=True)
        kept_n = np.add.reduceat(all_n[order][keep], head)
        state.update((kept_sec.tolist(), kept_n.tolist()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            {
                user: pdf[user].to_numpy(),
                second: t,
                tie: pdf[tie].to_numpy(),
                "prior": prior,
                "allowed": (prior < limit).astype("int64"),
            }
        )

    return (
        events.select(user, F.col(second).cast("long").alias(second), F.col(tie).cast("long").alias(tie))
        .groupBy(user)
        .applyInPandasWithState(step, out, state_type, "append", _timeout(idle_ms))
        .withColumn("allowed", F.col("allowed") == 1)
    )


def history_stream(
    messages: DataFrame,
    conversation: str,
    turn: str,
    text: str,
    keep: int = k.HISTORY_KEEP,
    closed: str | None = None,
    idle_ms: int | None = 3_600_000,
    carry: bool = False,
) -> DataFrame:
    """Keyed history: last ``keep`` texts before each message, state as large as that.

    ``carry`` returns the message's own text too, for a scorer in the same query.

    A message enters the history whatever its verdict.  A row whose ``closed`` column is
    true ends the conversation and drops its state; idle conversations expire.
    """
    out = StructType(
        [
            messages.schema[conversation],
            messages.schema[turn],
            StructField("history", ArrayType(StringType())),
            *([messages.schema[text]] if carry else []),
        ]
    )
    state_type = StructType([StructField("last", ArrayType(StringType()))])

    def step(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(turn)
        seen = []
        ends = pdf[closed].tolist() if closed else [False] * len(pdf)
        for message, end in zip(pdf[text], ends):
            seen.append(last)
            last = [] if end else (last + [message])[-keep:]
        if ends[-1]:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        own = {text: pdf[text]} if carry else {}
        yield pd.DataFrame({conversation: pdf[conversation], turn: pdf[turn], "history": seen, **own})

    cols = [conversation, turn, text] + ([closed] if closed else [])
    return (
        messages.select(*cols)
        .groupBy(conversation)
        .applyInPandasWithState(step, out, state_type, "append", _timeout(idle_ms))
    )


def duplicates_stream(
    messages: DataFrame,
    keys: list[str],
    millis: str,
    row_id: str,
    gap_ms: int = k.DUPLICATE_GAP_MS,
    idle_ms: int | None = 60_000,
) -> DataFrame:
    """Exact near-time duplicate drop: the state is the last kept time per key."""
    out = StructType([*[messages.schema[c] for c in keys], StructField(millis, LongType()), StructField(row_id, LongType())])
    state_type = StructType([StructField("kept", LongType())])

    def step(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values([millis, row_id])
        mask = []
        for ms in pdf[millis]:
            fresh = kept is None or ms - kept >= gap_ms
            mask.append(fresh)
            kept = int(ms) if fresh else kept
        state.update((kept,))
        if idle_ms is not None:
            state.setTimeoutDuration(max(idle_ms, gap_ms))
        yield pdf[mask][[*keys, millis, row_id]]

    return (
        messages.select(*keys, F.col(millis).cast("long").alias(millis), F.col(row_id).cast("long").alias(row_id))
        .groupBy(*keys)
        .applyInPandasWithState(step, out, state_type, "append", _timeout(idle_ms))
    )


PART, DONE, TIMED_OUT, NO_PLACE = "part", "done", "timed_out", "no_place"


def assembled_stream(
    chunks: DataFrame, key: str, seq: str, chunk: str, last: str, time: str | None = None, delay: str = "10 seconds", wait_ms: int = 60_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Chunks of messages put in order: ``key, start, chunks, text, status``.

    Chunks are numbered from 0 and come in any order, over any number of micro-batches; ``last`` marks a message's
    last one. State holds what is ahead of a gap, by number. As soon as a run without a gap continues
    what went out, it goes out as one row, whose ``start`` is its first number; the row that reaches the
    last chunk is ``done``. A chunk that came before is dropped, one without a number goes out as ``no_place``.

    With ``time`` (a timestamp, watermark ``delay``) a message that gets no chunk for ``wait_ms`` of event
    time gives up: an unfinished one sends what it holds as ``timed_out``, in order, over the gaps, and its state
    goes. Without it state stays, that of a finished message as its numbers.

    Messages share ``buckets`` (fixed for a checkpoint): one call puts all chunks of a bucket together, since a call and
    its frames cost far more than a message's few chunks.
    """
    out = StructType([StructField("_key", StringType()), StructField("start", LongType()), StructField("chunks", LongType()), StructField("text", StringType()), StructField("status", StringType())])
    state_type = StructType([StructField("keys", StringType()), StructField("marks", BinaryType()), StructField("held", BinaryType()), StructField("texts", StringType())])

    def step(_, frames, state):
        import pandas as pd

        # Of each message: next number, number of the last chunk, newest time, time to give up. Of each chunk held: message, number, length.
        names, marks, held, whole = [], np.empty((0, 4), "int64"), np.empty((0, 3), "int64"), ""
        if state.exists:
            keys, raw, of_chunks, whole = state.get
            names = keys.split("\n")
            marks, held = np.frombuffer(raw, "int64").reshape(-1, 4), np.frombuffer(of_chunks, "int64").reshape(-1, 3)
        cut = np.concatenate([[0], np.cumsum(held[:, 2])]).tolist()
        texts = [whole[x:y] for x, y in zip(cut, cut[1:])]
        known, gone = len(names), []
        watermark = state.getCurrentWatermarkMs() if time is not None else 0
        new = pd.DataFrame(columns=["_key", seq, chunk, last, "_ms"]) if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        code, distinct = pd.factorize(np.concatenate([np.array(names, dtype=object), new["_key"].to_numpy(dtype=object)]))
        code, names = code[known:], np.array(distinct, dtype=object)
        marks = np.concatenate([marks, np.tile(np.array([0, -1, 0, 0]), (len(names) - known, 1))])
        said = np.array([t if isinstance(t, str) else "" for t in new[chunk]], dtype=object)
        moment = new["_ms"].to_numpy(dtype="float64", na_value=np.nan)
        dated = ~np.isnan(moment)
        np.maximum.at(marks[:, 2], code[dated], moment[dated].astype("int64"))
        placed = (new[seq].notna() & (new[seq] >= 0)).to_numpy(dtype=bool)
        gone += [(names[m], None, 1, t, NO_PLACE) for m, t in zip(code[~placed], said[~placed])]
        ends = (new[last].eq(True)).to_numpy(dtype=bool)[placed]
        code_placed, said, number = code[placed], said[placed], new[seq][placed].to_numpy(dtype="int64")
        marks[code_placed[ends], 1] = number[ends]  # the one that came last
        ahead = number >= marks[code_placed, 0]
        message, number = np.concatenate([held[:, 0], code_placed[ahead]]), np.concatenate([held[:, 1], number[ahead]])
        texts = np.concatenate([np.array(texts, dtype=object), said[ahead]])
        order = np.lexsort((number, message))  # stable: of equal numbers the first that came
        message, number, texts = message[order], number[order], texts[order]
        first = np.ones(len(order), bool)
        first[1:] = (message[1:] != message[:-1]) | (number[1:] != number[:-1])
        message, number, texts = message[first], number[first], texts[first]
        edge = np.searchsorted(message, np.arange(len(names) + 1))
        run = number == marks[message, 0] + np.arange(len(message)) - edge[message]
        size = np.bincount(message[run], minlength=len(names))
        before = marks[:, 0].copy()
        marks[:, 0] += size
        for m in np.flatnonzero(size):
            gone.append((names[m], before[m], size[m], "".join(texts[edge[m] : edge[m] + size[m]]), DONE if marks[m, 0] == marks[m, 1] + 1 else PART))
        stays = np.ones(len(names), bool)
        if time is not None:
            came = np.zeros(len(names), bool)
            came[code] = True
            marks[came, 3] = np.maximum(marks[came, 2] + wait_ms, watermark + 1)
            stays = came | (marks[:, 3] >= watermark)
            for m in np.flatnonzero(~stays & (marks[:, 0] != marks[:, 1] + 1)):
                own = slice(edge[m] + size[m], edge[m + 1])
                at = number[own]
                gone.append((names[m], at[0] if len(at) else marks[m, 0], len(at), "".join(texts[own]), TIMED_OUT))
        keep = ~run & stays[message]
        if stays.any():
            place = np.cumsum(stays) - 1
            texts = texts[keep]
            held = np.stack([place[message[keep]], number[keep], np.fromiter(map(len, texts), "int64", len(texts))], 1)
            state.update(("\n".join(names[stays]), marks[stays].tobytes(), held.astype("int64").tobytes(), "".join(texts)))
            if time is not None:
                state.setTimeoutTimestamp(int(max(marks[stays, 3].min(), watermark + 1)))
        elif state.exists:
            state.remove()
        if gone:
            yield pd.DataFrame(gone, columns=out.names).astype({"start": "Int64", "chunks": "int64"})

    if time is not None:
        chunks = chunks.withWatermark(time, delay)
    moment = F.lit(None).cast("long") if time is None else F.unix_millis(time)
    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    # Keys travel as one line of text, which holds any type, and are read back by Spark.
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    cols = [
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), F.to_json(F.struct(key), exact).alias("_key"),
        F.col(seq).cast("long").alias(seq), F.col(chunk).cast("string").alias(chunk), F.col(last).cast("boolean").alias(last), moment.alias("_ms"),
    ]
    put = chunks.select(*cols, *([time] if time else [])).groupBy("_bucket").applyInPandasWithState(step, out, state_type, "append", timeout)
    return put.select(F.from_json("_key", StructType([chunks.schema[key]]), exact)[key].alias(key), *out.names[1:])


def duplicates_by_watermark(messages: DataFrame, keys: list[str], ts: str, gap: str = "5 seconds") -> DataFrame:
    """Approximate form with builtins: a duplicate arriving within the watermark delay of
    the first one is dropped, also when it is up to one delay late."""
    return messages.withWatermark(ts, gap).dropDuplicatesWithinWatermark(keys)


def feedback_triggers(feedback: DataFrame, counter_path: str, checkpoint: str, threshold: int = k.RETRAIN_THRESHOLD):
    """Count feedback per micro-batch, fire at every ``threshold`` rows and reset.

    Each batch writes one counter row under its own batch id, so a replayed batch
    overwrites its own row and reads the same predecessor.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carry = 0
        if batch_id > 0:
            carry = (
                spark.read.schema("batch_id long, n long, fires long, carry long")
                .parquet(f"{counter_path}/batch={batch_id - 1}")
                .first()["carry"]
            )
        row = batch.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(batch_id).cast("long").alias("batch_id"),
            "n",
            F.floor((F.col("n") + carry) / threshold).alias("fires"),
            ((F.col("n") + carry) % threshold).alias("carry"),
        )
        row.write.mode("overwrite").parquet(f"{counter_path}/batch={batch_id}")

    return (
        feedback.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_status(updates: DataFrame, path: str, checkpoint: str, key: str, seq: str, columns: list[str]):
    """Last write wins per id.  Each batch appends its own reduced rows under its batch id
    (a replay overwrites them), so the work grows with the batch and not with the table;
    ``latest_status`` reduces on read and ``compact_status`` folds old batches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        _newest(batch.select(key, seq, *columns), key, seq, columns).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return (
        updates.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(rows: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in columns])


def latest_status(spark: SparkSession, path: str, schema: StructType, key: str, seq: str, columns: list[str]) -> DataFrame:
    return _newest(spark.read.schema(schema).parquet(path).select(key, seq, *columns), key, seq, columns)


def compact_status(spark: SparkSession, path: str, target: str, schema: StructType, key: str, seq: str, columns: list[str]) -> None:
    """Write the reduced table to a new folder, from which a later stream may go on: streams number
    their batches, so none overwrites the base."""
    latest_status(spark, path, schema, key, seq, columns).write.mode("overwrite").parquet(f"{target}/batch=base")


def stream_of(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """File stream over a folder or over one file.

    The last letter goes into a glob class, because the file source treats a plain path
    as a folder.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(f"{path[:-1]}[{path[-1]}]")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into Parquet and read the result."""
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
