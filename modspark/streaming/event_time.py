"""Keyed rules that follow event time: rows wait for the watermark, are decided in order, and leave no state behind.

A row is held until everything before it has come (``delay`` behind the newest time seen); then it is decided in
the order of time and id, however the rows were dealt over micro-batches.  A row that comes after its place was
closed goes out as ``late`` and one without a time as ``no_time``; neither counts for the others.  A timer of event
time releases rows and then drops what no later row can need, so an idle key holds nothing.

Spark drops rows behind the watermark before a keyed function sees them.  The watermark is therefore set ``FAR``
behind, and places and timers are moved by the same span: only rows later than that are dropped (and counted by
the query's progress).  Times before 1980 never pass the watermark, which starts at 1970.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from modspark import constants as k

BUCKETS = 1024
FAR_DAYS = 3650
FAR_MS = FAR_DAYS * 86_400_000
DECIDED, LATE, NO_TIME = "decided", "late", "no_time"

# Times and ids in order, and a memory of two arrays, give result columns and the new memory.
Decide = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]


def in_time_order(
    rows: DataFrame, keys: list[str], time: str, row_id: str, results: list[str], delay_ms: int, unit_ms: int,
    decide: Decide, useful_ms: int, free: dict[str, int] | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """``keys, at_ms, row_id, results (longs), status`` of a stream of rows with a timestamp ``time``.

    Rows of one ``unit_ms`` are decided together, by id. The first array of a key's memory holds units, and is of
    use for ``useful_ms`` after its last. ``free`` gives the results of rows whose first key is null, which wait for nothing.
    State is what the delay holds back, and the memory. Keys share ``buckets`` (fixed for a checkpoint): one call
    decides all keys of a bucket, since a call and its frames cost far more than a key's few rows.
    """
    out = StructType(
        [StructField("_key", StringType()), StructField("at_ms", LongType()), StructField(row_id, LongType())]
        + [StructField(c, LongType()) for c in results] + [StructField("status", StringType())]
    )
    longs = ArrayType(ArrayType(LongType()))
    state_type = StructType([StructField("keys", ArrayType(StringType())), *[StructField(c, longs) for c in ("at", "id", "a", "b")]])
    shift = FAR_MS - delay_ms

    def step(_, frames, state):
        import pandas as pd

        def made(names, at, ids, values, status):
            if values is not None:  # most rows; without nulls, plain arrays cost a tenth
                given = {c: np.broadcast_to(np.asarray(values[c], dtype="int64"), len(ids)) for c in results}
                return pd.DataFrame({"_key": names, "at_ms": at, row_id: ids, **given, "status": status})
            given = {c: pd.array([None] * len(ids), dtype="Int64") for c in results}
            return pd.DataFrame({"_key": names, "at_ms": pd.array(at, dtype="Int64"), row_id: pd.array(ids, dtype="Int64"), **given, "status": status})

        held = {}
        if state.exists:
            for name, *arrays in zip(*state.get):
                held[name] = tuple(np.array(v, dtype="int64") for v in arrays)
        mark = state.getCurrentWatermarkMs()
        closed = mark + shift if mark > 0 else -(2**62)
        came = {}
        if not state.hasTimedOut:
            new = pd.concat(list(frames), ignore_index=True)
            names, new_at, new_ids = (new[c].to_numpy() for c in ("_key", "at_ms", row_id))
            timeless = pd.isna(new_at)
            if timeless.any():
                yield made(names[timeless], [None] * int(timeless.sum()), new_ids[timeless].tolist(), None, NO_TIME)
            waits = ~timeless
            if free is not None:
                exempt = new["_free"].to_numpy(dtype=bool) & waits
                if exempt.any():
                    yield made(names[exempt], new_at[exempt].astype("int64"), new_ids[exempt].astype("int64"), free, DECIDED)
                waits &= ~exempt
            names, new_at, new_ids = names[waits], new_at[waits].astype("int64"), new_ids[waits].astype("int64")
            late = (new_at // unit_ms + 1) * unit_ms <= closed
            if late.any():
                yield made(names[late], new_at[late], new_ids[late], None, LATE)
            names, new_at, new_ids = names[~late], new_at[~late], new_ids[~late]
            codes, distinct = pd.factorize(names)
            order = np.lexsort((new_ids, new_at // unit_ms, codes))
            ends = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
            for i, name in enumerate(distinct):
                own = order[ends[i] : ends[i + 1]]
                came[name] = new_at[own], new_ids[own]
        none = np.empty(0, "int64")
        gone, kept, dues = [], [], []
        for name in held | came:
            at, ids, a, b = held.get(name, (none,) * 4)
            if name in came:
                more_at, more_ids = came[name]
                if len(at):
                    at, ids = np.concatenate([at, more_at]), np.concatenate([ids, more_ids])
                    order = np.lexsort((ids, at // unit_ms))
                    at, ids = at[order], ids[order]
                else:
                    at, ids = more_at, more_ids
            ready = int(np.searchsorted((at // unit_ms + 1) * unit_ms, closed, side="right"))
            if ready:
                values, a, b = decide(at[:ready] // unit_ms, ids[:ready], a, b)
                gone.append((name, at[:ready], ids[:ready], values))
                at, ids = at[ready:], ids[ready:]
            if len(a) and not len(at) and int(a[-1]) * unit_ms + useful_ms <= closed:
                a, b = a[:0], b[:0]
            if len(at) or len(a):
                kept.append((name, at.tolist(), ids.tolist(), a.tolist(), b.tolist()))
                dues.append((int(at[0]) // unit_ms + 1) * unit_ms if len(at) else int(a[-1]) * unit_ms + useful_ms)
        if gone:
            names = np.repeat(np.array([g[0] for g in gone], dtype=object), [len(g[1]) for g in gone])
            values = {c: np.concatenate([g[3][c] for g in gone]) for c in results}
            yield made(names, np.concatenate([g[1] for g in gone]), np.concatenate([g[2] for g in gone]), values, DECIDED)
        if kept:
            state.update(tuple(list(v) for v in zip(*kept)))
            state.setTimeoutTimestamp(max(min(dues) - shift - 1, mark + 1, 1))
        elif state.exists:
            state.remove()

    # Keys travel as text, which holds any type, and are read back by Spark.
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key_type = StructType([rows.schema[c] for c in keys])
    dated = rows.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), F.to_json(F.struct(*keys), exact).alias("_key"),
        F.col(keys[0]).isNull().alias("_free"), F.unix_millis(time).alias("at_ms"), F.col(row_id).cast("long").alias(row_id), F.col(time).alias("_at"),
    ).withWatermark("_at", f"{FAR_DAYS} days")
    decided = dated.groupBy("_bucket").applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)
    own = F.from_json("_key", key_type, exact)
    return decided.select(*[own[c].alias(c) for c in keys], "at_ms", row_id, *results, "status")


def rate_limit_by_time(
    events: DataFrame, user: str, time: str, tie: str, limit: int = k.RATE_LIMIT, window_s: int = k.RATE_WINDOW_S,
    delay_ms: int = 10_000,
) -> DataFrame:
    """The rate limit of a stream whose rows come out of order by up to ``delay_ms``, equal to the batch form.

    ``user, at_ms, tie, prior, allowed (1 or 0), status``. Rows without a user are not limited.
    """

    def decide(sec, ids, past, n):
        seconds, first, added = np.unique(sec, return_index=True, return_counts=True)
        every = np.concatenate([past, seconds])  # closed seconds all lie before the new ones
        sums = np.concatenate([[0], np.cumsum(np.concatenate([n, added]))])
        start = np.searchsorted(every, sec - (window_s - 1), side="left")
        prior = sums[np.searchsorted(every, sec, side="left")] - sums[start] + np.arange(len(sec)) - first[np.searchsorted(seconds, sec)]
        kept = every > every[-1] - window_s
        return {"prior": prior, "allowed": (prior < limit).astype("int64")}, every[kept], np.diff(sums)[kept]

    return in_time_order(
        events, [user], time, tie, ["prior", "allowed"], delay_ms, 1000, decide, window_s * 1000, {"prior": 0, "allowed": 1}
    )


def duplicates_by_time(
    messages: DataFrame, keys: list[str], time: str, row_id: str, gap_ms: int = k.DUPLICATE_GAP_MS, delay_ms: int = 10_000
) -> DataFrame:
    """Near-time duplicates of a stream whose rows come out of order by up to ``delay_ms``, equal to the batch form.

    ``keys, at_ms, row_id, kept (1 or 0), status``: a row is kept if no kept row of its keys lies less than ``gap_ms`` before.
    """

    def decide(ms, ids, last, _):
        kept = np.zeros(len(ms), dtype="int64")
        free = int(last[-1]) + gap_ms if len(last) else int(ms[0])
        while (i := int(np.searchsorted(ms, free, side="left"))) < len(ms):
            kept[i] = 1
            last = ms[i : i + 1]
            free = int(ms[i]) + gap_ms if gap_ms else int(ms[i]) + 1
        return {"kept": kept}, last, last

    return in_time_order(messages, keys, time, row_id, ["kept"], delay_ms, 1, decide, gap_ms)
