"""Ordered operators: rate limit, conversation history, near-time duplicates.

All of them cut a key's time line into blocks and carry the little state that
crosses a block border, so one very busy user or conversation is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modspark import constants as k
from modspark.functions.text import last_n

HISTORY_BLOCK = 1024
DUPLICATE_BLOCK_MS = 60_000
DUPLICATE_RUN_BLOCKS = 8
TIE_BLOCK = 1 << 20


def rate_limit(
    df: DataFrame,
    user: str,
    second: str,
    tie: str,
    limit: int = k.RATE_LIMIT,
    window_s: int = k.RATE_WINDOW_S,
    then: Sequence[str] = (),
) -> DataFrame:
    """Adds ``prior`` (live earlier attempts) and ``allowed``.

    An attempt is live for the ``window_s - 1`` seconds after its own; rejected attempts
    count.  Attempts are first counted per second.  Each second takes part in its own
    time block and the next one, which makes every window frame local to a block of at
    most ``2 * window_s`` seconds.  Order inside a second is ``tie`` (an integer), and
    ``then`` where that is equal.  Rows without a user or time cannot be counted and pass.
    """
    rows = df.withColumn("_tb", F.floor(F.col(tie) / TIE_BLOCK))
    per = rows.groupBy(user, second, "_tb").agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col(second) / window_s)
    in_blocks = per.withColumn("_own", block).withColumn(
        "_blk", F.explode(F.array(block, block + 1))
    )
    live = (
        Window.partitionBy(user, "_blk").orderBy(second).rangeBetween(-(window_s - 1), -1)
    )
    same = (
        Window.partitionBy(user, "_blk", second)
        .orderBy("_tb")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        in_blocks.withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(live), F.lit(0))
            + F.coalesce(F.sum("_n").over(same), F.lit(0)),
        )
        .filter(F.col("_blk") == F.col("_own"))
        .select(user, second, "_tb", "_before")
    )
    inside = Window.partitionBy(user, second, "_tb").orderBy(tie, *then)
    known = F.col(user).isNotNull() & F.col(second).isNotNull()
    return (
        rows.join(before, [user, second, "_tb"], "left")
        .withColumn(
            "prior",
            F.when(known, F.col("_before") + F.row_number().over(inside) - 1).otherwise(F.lit(0)),
        )
        .withColumn("allowed", F.col("prior") < limit)
        .drop("_tb", "_before")
    )


def history(
    df: DataFrame,
    conversation: str,
    turn: str,
    text: str,
    keep: int = k.HISTORY_KEEP,
    block: int = HISTORY_BLOCK,
    name: str = "history",
) -> DataFrame:
    """The last ``keep`` texts before every turn, oldest first.

    Turns are windowed in blocks.  Only conversations longer than one block need what
    earlier blocks end with; their block tails (``keep`` texts each) are carried over.
    """
    rows = df.withColumn("_blk", F.floor(F.col(turn) / block))
    w = Window.partitionBy(conversation, "_blk").orderBy(turn)
    local = rows.withColumn(name, F.collect_list(text).over(w.rowsBetween(-keep, -1)))

    long_ones = (
        df.filter(F.col(turn) >= block).select(F.col(conversation).alias("_c")).distinct()
    )
    source = rows.join(long_ones, F.col(conversation) == F.col("_c"), "left_semi")
    newest = Window.partitionBy(conversation, "_blk").orderBy(F.desc(turn))
    tails = (
        source.withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= keep)
        .groupBy(conversation, "_blk")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("x")))),
                lambda e: e["x"],
            ).alias("_tail")
        )
    )
    by_block = Window.partitionBy(conversation).orderBy("_blk").rowsBetween(-keep, -1)
    carried = tails.select(
        conversation,
        "_blk",
        last_n(F.flatten(F.collect_list("_tail").over(by_block)), keep).alias("_carried"),
    )
    joined = local.join(carried, [conversation, "_blk"], "left")
    both = F.when(
        F.col("_carried").isNull(), F.col(name)
    ).otherwise(F.concat(F.col("_carried"), F.col(name)))
    return joined.withColumn(name, last_n(both, keep)).drop("_blk", "_carried")


def context_string(turns: Column, use: int = k.CONTEXT_TURNS) -> Column:
    """Last turns joined by a space; null when there are none."""
    return F.when(F.size(turns) > 0, F.array_join(last_n(turns, use), " "))


def segments(turns: Column, message: Column, use: int = k.CONTEXT_TURNS) -> Column:
    """Context first and message second; the message alone without context."""
    context = context_string(turns, use)
    has = context.isNotNull() & (context != "")
    return F.struct(
        F.when(has, context).otherwise(message).alias("segment_a"),
        F.when(has, message).alias("segment_b"),
    )


def drop_near_duplicates(
    df: DataFrame,
    keys: Sequence[str],
    millis: str,
    row_id: str,
    gap_ms: int = k.DUPLICATE_GAP_MS,
    block_ms: int | None = None,
) -> DataFrame:
    """Keep a row unless an already *kept* row of the same keys is less than ``gap_ms``
    older.  A dropped row does not shadow later ones.

    Candidates are the first row per key and millisecond (combined map-side), cut into
    blocks of the time line.  Blocks whose neighbours are at least one gap away start
    fresh; runs of linked blocks are found on the block table.  Short runs (at most
    ``DUPLICATE_RUN_BLOCKS`` blocks, so a bounded number of candidates) are folded in the
    JVM.  A flood that links more blocks goes through ``_flood_survivors``, which works
    block by block.
    """
    block_ms = max(block_ms or DUPLICATE_BLOCK_MS, gap_ms)
    # One never-null key of fixed size, whatever the columns (a content may be long).
    marked = df.withColumn("_key", F.sha2(F.to_json(F.struct(*keys)), 256))
    keys = ["_key"]
    firsts = marked.groupBy("_key", millis).agg(F.min(row_id).alias("_id"))
    firsts = firsts.select(
        "_key", F.col(millis).alias("_ms"), "_id", F.floor(F.col(millis) / block_ms).alias("_blk")
    )
    per_block = firsts.groupBy(*keys, "_blk").agg(F.min("_ms").alias("_lo"), F.max("_ms").alias("_hi"))
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    fresh = F.col("_lo") - F.lag("_hi").over(by_block) >= gap_ms
    started = per_block.withColumn("_start", F.when(F.coalesce(fresh, F.lit(True)), F.col("_blk")))
    runs = started.withColumn("_run", F.last("_start", ignorenulls=True).over(by_block))
    in_run = Window.partitionBy(*keys, "_run")
    runs = runs.withColumn("_len", F.count(F.lit(1)).over(in_run)).select(*keys, "_blk", "_run", "_len")
    placed = firsts.join(runs, [*keys, "_blk"])

    start = F.struct(
        F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ids")
    )
    short = (
        placed.filter(F.col("_len") <= DUPLICATE_RUN_BLOCKS)
        .groupBy(*keys, "_run")
        .agg(F.array_sort(F.collect_list(F.struct("_ms", "_id"))).alias("_rows"))
        .select(
            F.explode(
                F.aggregate(
                    "_rows",
                    start,
                    lambda acc, r: F.when(
                        acc["last"].isNull() | (r["_ms"] - acc["last"] >= gap_ms),
                        F.struct(
                            r["_ms"].alias("last"), F.array_append(acc["ids"], r["_id"]).alias("ids")
                        ),
                    ).otherwise(acc),
                )["ids"]
            ).alias("_kept")
        )
    )
    floods = placed.filter(F.col("_len") > DUPLICATE_RUN_BLOCKS).drop("_len", "_run")
    kept = short.unionByName(_flood_survivors(floods, keys, gap_ms, block_ms))
    return df.join(kept, F.col(row_id) == F.col("_kept"), "left_semi")


def _flood_survivors(firsts: DataFrame, keys: list[str], gap_ms: int, block_ms: int) -> DataFrame:
    """Kept ids of long runs.

    1. Per block: what the last kept time would be for each possible first kept row near
       the block start.
    2. These few break points are folded per key, block by block.
    3. Blocks replay with the known incoming state.
    """
    key_fields = [firsts.schema[c] for c in keys]

    def exits(pdf):
        import numpy as np
        import pandas as pd

        ms = np.sort(pdf["_ms"].to_numpy())
        n = len(ms)
        nxt = np.searchsorted(ms, ms + gap_ms)
        last = np.where(nxt < n, nxt, np.arange(n))
        while True:  # pointer doubling: last kept row of the chain from each row
            further = last[last]
            if (further == last).all():
                break
            last = further
        start = int(pdf["_blk"].iloc[0]) * block_ms
        near = int(np.searchsorted(ms, start + gap_ms)) + 1
        entry, out = ms[:near], ms[last[:near]]
        cut = np.append(out[1:] != out[:-1], True)  # equal results in a row: keep the last
        frame = pd.DataFrame({c: [pdf[c].iloc[0]] * int(cut.sum()) for c in keys})
        frame["_blk"] = pdf["_blk"].iloc[0]
        frame["_entry"], frame["_exit"] = entry[cut], out[cut]
        return frame

    exit_schema = StructType(
        key_fields
        + [StructField(c, LongType()) for c in ("_blk", "_entry", "_exit")]
    )
    points = firsts.groupBy(*keys, "_blk").applyInPandas(exits, exit_schema)

    def fold(pdf):
        import pandas as pd

        free_from = -(2**62)
        blocks, incoming = [], []
        for blk, part in pdf.sort_values(["_blk", "_entry"]).groupby("_blk", sort=True):
            blocks.append(blk)
            incoming.append(free_from)
            later = part[part["_entry"] >= free_from]
            if len(later):
                free_from = int(later["_exit"].iloc[0]) + gap_ms
        frame = pd.DataFrame({c: [pdf[c].iloc[0]] * len(blocks) for c in keys})
        frame["_blk"], frame["_free"] = blocks, incoming
        return frame

    fold_schema = StructType(
        key_fields + [StructField("_blk", LongType()), StructField("_free", LongType())]
    )
    incoming = points.groupBy(*keys).applyInPandas(fold, fold_schema)

    def replay(left, right):
        import numpy as np
        import pandas as pd

        left = left.sort_values("_ms")
        ms, ids = left["_ms"].to_numpy(), left["_id"].to_numpy()
        kept = []
        i = int(np.searchsorted(ms, right["_free"].iloc[0])) if len(right) else 0
        while i < len(ms):
            kept.append(ids[i])
            i = int(np.searchsorted(ms, ms[i] + gap_ms))
        return pd.DataFrame({"_kept": pd.Series(kept, dtype="int64")})

    return (
        firsts.groupBy(*keys, "_blk")
        .cogroup(incoming.groupBy(*keys, "_blk"))
        .applyInPandas(replay, StructType([StructField("_kept", LongType())]))
    )


def packed_context(
    community: Column, user: Column, turns: Column, roles: Column, text: Column, role: Column
) -> Column:
    """Community, user, earlier turns with their distance, current message."""
    lines = F.transform(
        F.arrays_zip(roles.alias("r"), turns.alias("t")),
        lambda e, i: F.concat(
            F.lit("[TURN-"),
            (F.size(turns) - i).cast("string"),
            F.lit("] "),
            e["r"],
            F.lit(": "),
            e["t"],
        ),
    )
    head = F.array(
        F.concat(F.lit("[COMMUNITY="), community, F.lit("]")),
        F.concat(F.lit("[USER="), user, F.lit("]")),
    )
    tail = F.array(F.concat(F.lit("[CURRENT] "), role, F.lit(": "), text))
    return F.array_join(F.concat(head, lines, tail), "\n")
