"""Validation, rewrite routing, tenant policies, audit rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions import scores as S
from modspark.functions import text as T
from modspark.session import broadcast_if_small

ACTION_RANK = {"allow": 0, "warn": 1, "review": 2, "block": 3}


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the broken rules in order; a rule that is null counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def request_rules(text: str = "text") -> dict[str, Column]:
    return {
        "text_missing": F.col(text).isNotNull(),
        "text_empty": F.coalesce(F.length(text) >= 1, F.lit(True)),
        "text_too_long": F.coalesce(F.length(text) <= k.TEXT_MAX, F.lit(True)),
    }


def batch_rules(texts: str = "texts") -> dict[str, Column]:
    return {"batch_size": F.size(texts).between(1, k.BATCH_MAX)}


def feedback_rules(notes: str = "notes") -> dict[str, Column]:
    return {"notes_too_long": F.coalesce(F.length(notes) <= k.NOTES_MAX, F.lit(True))}


def channel_rules(name: str = "name", description: str = "description") -> dict[str, Column]:
    return {
        "name_length": F.length(name).between(2, 50),
        "description_length": F.coalesce(F.length(description) <= 255, F.lit(True)),
    }


def user_rules(display_name: str = "display_name") -> dict[str, Column]:
    return {"display_name_length": F.length(display_name).between(2, 50)}


def score_rules(scores: str = "scores") -> dict[str, Column]:
    return {"score_range": F.forall(scores, lambda s: s.between(0.0, 1.0))}


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows with their rule names)."""
    checked = df.withColumn("violations", violations(rules))
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


def bypass(skip: Column, message_type: Column) -> Column:
    """Messages that are delivered without scoring."""
    return F.coalesce(skip, F.lit(False)) | F.coalesce(message_type == "safe_message", F.lit(False))


def rewrites(
    df: DataFrame, row_id: str, external: DataFrame | None = None, text: str = "text", language: str = "language"
) -> DataFrame:
    """Rewrite of every given row: the external one unless it is missing or generic,
    else the local scrub.  ``external`` is ``(row_id, rewrite)``."""
    out = df
    if external is not None:
        out = out.join(external, row_id, "left")
    else:
        out = out.withColumn("rewrite", F.lit(None).cast("string"))
    answer = T.strip_quotes(T.strip(F.col("rewrite")))
    out = out.withColumn("_answer", answer)
    usable = ~T.is_generic_reply(F.col("_answer"))
    return out.select(
        *df.columns,
        F.col(text).alias("original"),
        F.when(usable, F.col("_answer")).otherwise(T.scrub_rewrite(F.col(text))).alias("detoxified"),
        F.when(usable, F.lit("external")).otherwise(F.lit("intent_preserving_scrubber")).alias("method"),
        F.when(usable, F.lit(0.95)).otherwise(F.lit(0.85)).alias("confidence"),
    )


def template_rewrites(df: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Fixed reply by language."""
    return df.select(
        "*",
        F.col(text).alias("original"),
        T.reply_template(F.col(language)).alias("detoxified"),
        F.lit("template").alias("method"),
        F.lit(0.50).alias("confidence"),
    )


def rewrite_where_needed(
    df: DataFrame, row_id: str, external: DataFrame | None = None, text: str = "text", language: str = "language"
) -> DataFrame:
    """Adds ``suggestion``: rewritten for toxic MEDIUM/HIGH rows, null elsewhere.

    Without external rewrites this is one ``when`` (builtins are lazy, one scan).  With
    them only the rows that need a rewrite take part in the join.
    """
    needs = S.needs_rewrite(F.col("is_toxic"), F.col("severity"))
    if external is None:
        return df.withColumn("suggestion", F.when(needs, T.scrub_rewrite(F.col(text))))
    answers = rewrites(df.filter(needs).select(row_id, text, language), row_id, external, text, language)
    return df.join(answers.select(row_id, F.col("detoxified").alias("suggestion")), row_id, "left")


def accept_suggestions(messages: DataFrame, accepted: DataFrame, key: str = "message_id") -> DataFrame:
    """Accepted rewrites replace the text; the message becomes delivered and safe.

    ``accepted`` is ``(key, suggestion)`` with one row per message.
    """
    picked = accepted.select(key, F.col("suggestion").alias("_new"))
    took = F.col("_new").isNotNull()
    return (
        messages.join(picked, key, "left")
        .withColumn("content", F.coalesce("_new", "content"))
        .withColumn("status", F.when(took, k.DELIVERED).otherwise(F.col("status")))
        .withColumn("is_toxic", F.col("is_toxic") & ~took)
        .withColumn("severity", F.when(took, "SAFE").otherwise(F.col("severity")))
        .drop("_new")
    )


def policy_actions(
    long: DataFrame, policies: DataFrame, row_id: str, tenant: str = "tenant"
) -> DataFrame:
    """Strictest action per row; ``allow`` where no policy fits, also for unknown tenants.

    ``policies`` is ``(tenant, tag, min_score, action, version)``; one row per cut.  The
    join is broadcast only when the policy table passes the size check; otherwise it
    shuffles on (tenant, tag) and AQE splits hot tenants.
    """
    rank = T.literal_map(ACTION_RANK)
    joined = long.join(broadcast_if_small(policies), [tenant, "tag"], "left")
    fired = F.when(
        F.col("score") >= F.col("min_score"),
        F.struct(F.element_at(rank, F.col("action")).alias("r"), F.col("action").alias("a")),
    )
    return joined.groupBy(row_id, tenant).agg(
        F.coalesce(F.max(fired)["a"], F.lit("allow")).alias("action"),
        F.max("version").alias("policy_version"),
    )


def audit_rows(decisions: DataFrame, model_version: str, policy_version: Column) -> DataFrame:
    return decisions.withColumn("model_version", F.lit(model_version)).withColumn(
        "policy_version", policy_version
    )
