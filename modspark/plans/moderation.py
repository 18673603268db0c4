"""End-to-end moderation of a table of messages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions import lang as L
from modspark.functions import scores as S
from modspark.functions import text as T
from modspark.operators import policy as P
from modspark.operators import scoring
from modspark.operators import windows as W
from modspark.operators.windows import context_string, rate_limit
from modspark.session import broadcast_if_small, scratch_path


@dataclass
class Moderated:
    results: DataFrame
    rejected: DataFrame | None
    invalid: DataFrame


def score_messages(
    df: DataFrame,
    scorer: scoring.Scorer | scoring.ContextScorer | None = None,
    skip: Column | None = None,
    gate: Column | None = None,
    fallback_language: Column | None = None,
    version: str = k.LEXICON_VERSION,
    compose: bool = True,
    history: Column | None = None,
    turns: int = k.CONTEXT_TURNS,
) -> DataFrame:
    """Normalise, detect the language, score, bucket and decide; one row per message.

    A context scorer gets the last ``turns`` texts of ``history`` (an array, oldest first) before
    the message; without history it scores the message alone.

    Column scorers (lexicon, Arrow plug-in) get the text masked to the rows that need a
    score, in one scan; any other scorer gets these rows by filter.
    Works on batch and streaming frames.
    """
    skip = F.lit(False) if skip is None else skip
    marked = df.withColumn("_skip", skip).withColumn(
        "detected_language",
        F.when(F.col("_skip"), F.lit("en")).otherwise(L.detect_language(F.col("text"), fallback_language)),
    )
    zeros = F.array(*[F.lit(0.0)] * len(k.LABELS))
    model = F.when(F.col("_skip"), k.BYPASS_VERSION).otherwise(version)
    scorer = scoring.lexicon_scorer() if scorer is None else scorer
    if isinstance(scorer, scoring.ColumnScorer | scoring.ContextScorer):
        # The mask is on the text, so Python functions in the expression see nulls there.
        masked = F.when(~F.col("_skip"), F.col("text"))
        out = marked.withColumn("normalized", T.normalize_for_toxicity(masked, compose=compose))
        todo = F.when(~F.col("_skip"), F.col("normalized"))
        if isinstance(scorer, scoring.ContextScorer):
            before = F.lit(None).cast("string") if history is None else context_string(history, turns)
            scores = scorer.expr(todo, before)
        else:
            scores = scorer.expr(todo)
        out = out.withColumn("scores", F.coalesce(scores, zeros))
    else:
        todo = marked.filter(~F.col("_skip")).withColumn(
            "normalized", T.normalize_for_toxicity(F.col("text"), compose=compose)
        )
        done = scorer(todo)
        safe = marked.filter("_skip").withColumn("normalized", F.lit("")).withColumn("scores", zeros)
        out = done.unionByName(safe)
    out = out.withColumn("model_version", model)
    applied = None if gate is None else F.when(~F.col("_skip"), gate)
    return scoring.moderated(out, gate=applied).drop("_skip", "scores", "normalized")


def moderate_conversations(
    df: DataFrame,
    conversation: str,
    turn: str,
    scorer: scoring.ContextScorer | None = None,
    turns: int = k.CONTEXT_TURNS,
    compose: bool = True,
) -> DataFrame:
    """Each message of ``df`` (with a ``text``) scored after the last ``turns`` of its conversation, whatever their
    verdicts. A null text is an empty message."""
    said = df.withColumn("text", F.coalesce("text", F.lit("")))
    with_history = W.history(said, conversation, turn, "text", max(turns, k.HISTORY_KEEP))
    scorer = scoring.lexicon_context_scorer() if scorer is None else scorer
    return score_messages(with_history, scorer, compose=compose, history=F.col("history"), turns=turns)


def moderate(
    df: DataFrame,
    scorer: scoring.Scorer | scoring.ContextScorer | None = None,
    row_id: str = "message_id",
    limits: tuple[int, int] | None = None,
    external_rewrites: DataFrame | None = None,
    skip: Column | None = None,
    gate: Column | None = None,
    fallback_language: Column | None = None,
    compose: bool = True,
    history: Column | None = None,
    turns: int = k.CONTEXT_TURNS,
) -> Moderated:
    """Rate limit, bounds, bypass, scoring, rewrite and status.

    ``history`` (an array of earlier texts of each row, see ``operators.windows.history``) goes to
    a context scorer, the last ``turns`` of it.

    ``df`` has ``message_id, text`` and, with ``limits = (count, seconds)``, also
    ``user_id``, ``second`` and an integer ``arrival`` order. Every row is an attempt, also
    with a null or repeated id: each comes out once, in one of the three.
    """
    rejected = None
    accepted = df
    if limits is not None:
        # First, as in the live flow. Only ids and times are shuffled for the counts; the refused
        # attempts, few as a rule, then meet the texts. Attempts that are alike in all of these follow
        # each other in the order, so how many of them are refused, and from which place, says all.
        attempt = [row_id, "user_id", "second", "arrival"]
        checked = rate_limit(df.select(attempt), "user_id", "second", "arrival", *limits, then=[row_id])
        refused = checked.filter(~F.col("allowed")).groupBy(attempt)
        refused = refused.agg(F.count(F.lit(1)).alias("_n"), F.min("prior").alias("_from"), F.max("prior").alias("_to"))
        refused = refused.withColumnsRenamed({c: f"_{c}" for c in attempt})
        # Stored, ids only: five branches of the result read it, and lost executors cost no second count.
        stored = scratch_path(df.sparkSession, "refused")
        refused.write.parquet(stored)
        refused = broadcast_if_small(df.sparkSession.read.schema(refused.schema).parquet(stored))
        same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(F.col(f"_{c}")) for c in attempt])
        by = Window.partitionBy(attempt).orderBy(F.xxhash64(*df.columns))
        met = df.join(refused, same).withColumn("_nth", F.row_number().over(by))
        prior = F.least(F.col("_from") + F.col("_nth") - 1, "_to").alias("prior")
        rejected = met.filter("_nth <= _n").select(*df.columns, prior)
        accepted = df.join(refused, same, "left_anti").unionByName(met.filter("_nth > _n").select(df.columns))
    valid, invalid = P.quarantine(accepted, P.request_rules())
    scored = score_messages(
        valid, scorer, skip, gate, fallback_language, compose=compose, history=history, turns=turns
    )
    results = P.rewrite_where_needed(
        scored, row_id, external_rewrites, language="detected_language"
    )
    return Moderated(results, rejected, invalid)


def every_message(out: Moderated) -> DataFrame:
    """One row per message that came in: results with their ``status``, and, with null scores, rows that were
    RATE_LIMITED or INVALID. ``reasons`` holds the rules that a row broke."""
    done = out.results.withColumn("reasons", F.array().cast("array<string>"))
    bad = out.invalid.withColumn("status", F.lit("INVALID")).withColumnRenamed("violations", "reasons")
    rows = done.unionByName(bad, allowMissingColumns=True)
    if out.rejected is not None:
        late = out.rejected.drop("prior").withColumn("status", F.lit("RATE_LIMITED")).withColumn("reasons", F.array(F.lit("rate_limit")))
        rows = rows.unionByName(late, allowMissingColumns=True)
    return rows


def response_fields(df: DataFrame) -> DataFrame:
    """Result values under all the names clients read."""
    return df.select(
        "*",
        F.col("is_toxic").alias("toxic"),
        F.col("is_toxic").alias("flagged"),
        F.col("overall_score").alias("score"),
        F.col("suggestion").alias("detoxified"),
        F.col("suggestion").alias("rewrite"),
    )
