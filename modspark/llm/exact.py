"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.common import shuffle_partitions, stored, texts_of

FAN = 16
ROWS_PER_RUN = 100_000
KEY = ["digest", "check", "n_norm"]


def normalised(text):
    """The text without ASCII white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]", "")


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: digest of the normalised text, and what verifies it.

    ``check`` (a second hash) and ``n_norm`` (length) belong to the key: should two texts ever
    share a digest, they stay apart.
    """
    norm = normalised(F.col("text"))
    return texts_of(docs).select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.length(norm).alias("n_norm"),
        F.length(F.coalesce("text", F.lit(""))).alias("points"),
    )


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted rows: the first of each (run, key), with the sum of ``n``. Holds one row over a batch's end."""
    last = None
    for batch in batches:
        if last is not None:
            batch = pd.concat([last, batch], ignore_index=True)
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        new[0] = True
        for c in ["run", *KEY]:
            v = batch[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new)
        heads = batch.iloc[at].copy()
        heads["n"] = np.add.reduceat(batch["n"].to_numpy(), at)
        last = heads.iloc[-1:]
        if len(heads) > 1:
            yield heads.iloc[:-1]
    if last is not None:
        yield last


def merge_round(runs: DataFrame, fan: int) -> DataFrame:
    """Every ``fan`` neighbouring runs become one: each key once, with its best row and its count.

    Rows go by (run, key), so a frequent key has as many places as there are runs. Spark's
    sort merges what arrives; ``_heads`` walks over it once.
    """
    n = shuffle_partitions(runs.sparkSession)
    best = [F.col("points").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id").asc()]
    dealt = runs.withColumn("run", F.floor(F.col("run") / fan)).repartition(n, "run", "digest")
    return dealt.sortWithinPartitions("run", *KEY, *best).mapInPandas(_heads, dealt.schema)


def exact_groups(docs: DataFrame, fan: int = FAN, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after deletion of ASCII white space. The row with the most
    code points stays, then the smallest doc_id. Null text counts as empty; a null doc_id comes
    after all others; of rows repeated with their doc_id exactly one stays. An empty table
    gives an empty result. Columns besides ``doc_id`` and ``text`` are ignored.

    Rows are dealt to ``fan ** levels`` runs by row. Round after round ``fan`` runs merge, until
    one run, still spread over all partitions by key, holds each digest once. The verdict goes
    back by (run, digest): a text that a third of all rows share meets a join in as many parts
    as there are runs.
    """
    rows = stored(digests(docs), "digests")
    levels = max(2, math.ceil(math.log(max(rows.count() / rows_per_run, 1), fan)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row_id"), F.lit(fan**levels)))
    first = stored(merge_round(rows.withColumn("n", F.lit(1).cast("long")), 1), "runs")
    merged = first
    for _ in range(levels):
        merged = merge_round(merged, fan)
    best = merged.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.col("n").alias("group_size"))
    told = first.select("run", *KEY).join(best, KEY)
    return rows.join(told, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; repeated doc_ids with one text stay once."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.sha2(normalised(F.col("text")), 256) == F.col("kept_sha"))
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select("row.*")
