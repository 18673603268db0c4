"""Scorers: text in, six scores in [0, 1] out, as a DataFrame step.

* ``lexicon_scorer``      built-in expressions, no shuffle
* ``term_table_scorer``   large weighted term tables: explode, join, sum
* ``plugin_scorer``       any vectorised Python model in Arrow batches
* ``cascade``             cheap scorer first, strong scorer only for uncertain rows
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from modspark import constants as k
from modspark.functions import scores as S
from modspark.functions import text as T
from modspark.functions.text import WORD
from modspark.session import broadcast_if_small

Scorer = Callable[[DataFrame], DataFrame]
SCALE_SALTS = 64


@dataclass(frozen=True)
class ColumnScorer:
    """Scorer made of one expression over the text: ``expr(text) -> array of scores``.

    A null text gets null scores and no model work, so callers mask the rows that need no
    score and everything stays in one scan.
    """

    expr: Callable[[Column], Column]
    text: str = "normalized"
    out: str = "scores"

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, self.expr(F.col(self.text)))


def lexicon_scorer(
    lexicon: Mapping[str, Sequence[int]] | None = None, text: str = "normalized", out: str = "scores"
) -> ColumnScorer:
    return ColumnScorer(lambda c: S.lexicon_scores(c, lexicon), text, out)


@dataclass(frozen=True)
class ContextScorer:
    """Scorer over two segments: ``expr(message, context) -> array of scores``.

    The context is null where a message has none. A null message gets null scores.
    """

    expr: Callable[[Column, Column], Column]


def lexicon_context_scorer(lexicon: Mapping[str, Sequence[int]] | None = None, part: int = 4) -> ContextScorer:
    return ContextScorer(lambda message, context: S.lexicon_scores_in_context(message, F.lower(context), lexicon, part))


def term_table_scorer(
    df: DataFrame,
    terms: DataFrame,
    row_id: str,
    text: str,
    out: str = "scores",
    salts: int = SCALE_SALTS,
) -> DataFrame:
    """Scores from a table ``(term, tag, weight)`` of any size.

    Within the checked bound the terms are broadcast and each task keeps only its hits, so
    what is shuffled is one point row per text.  A larger table is joined by shuffle: equal
    tokens of a text are counted first and the very frequent ones are spread over ``salts``
    copies of the term rows.
    """
    tokens = df.select(
        row_id, F.explode(F.split(F.lower(text), f"[^{WORD}]+")).alias("term")
    ).filter(F.col("term") != "")
    small = broadcast_if_small(terms)
    if small is not terms:
        hits = tokens.withColumn("_n", F.lit(1)).join(small, "term")
    else:
        counted = tokens.groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("_n"))
        salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = counted.withColumn(
            "_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
        ).join(salted, ["term", "_salt"])
    points = hits.groupBy(row_id).agg(
        F.array(
            *[
                F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("weight") * F.col("_n"))), F.lit(0))
                for t in k.LABELS
            ]
        ).alias("_points")
    )
    zeros = F.array(*[F.lit(0).cast("long")] * len(k.LABELS))
    return (
        df.join(points, row_id, "left")
        .withColumn(out, S.points_to_scores(F.coalesce("_points", zeros)))
        .drop("_points")
    )


def plugin_scorer(
    load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]],
    text: str = "normalized",
    out: str = "scores",
) -> ColumnScorer:
    """``load()`` runs once per task and returns a function of a batch of texts.

    Only the text column travels by Arrow, and the model gets the non-null texts only.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            present = texts.dropna()
            scores = [list(map(float, row)) for row in model(present.tolist())] if len(present) else []
            yield pd.Series(scores, index=present.index, dtype="object").reindex(texts.index).map(
                lambda v: v if isinstance(v, list) else None
            )

    return ColumnScorer(F.pandas_udf(run, ArrayType(DoubleType())), text, out)


def plugin_context_scorer(
    load: Callable[[], Callable[[Sequence[str], Sequence[str | None]], Sequence[Sequence[float]]]],
) -> ContextScorer:
    """``load()`` runs once per task and returns a function of a batch of messages and their contexts (None: none)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for messages, contexts in batches:
            here = messages.notna()
            before = [x if isinstance(x, str) else None for x in contexts[here]]
            scores = [list(map(float, row)) for row in model(messages[here].tolist(), before)] if len(before) else []
            yield pd.Series(scores, index=messages.index[here], dtype="object").reindex(messages.index).map(
                lambda v: v if isinstance(v, list) else None
            )

    return ContextScorer(F.pandas_udf(run, ArrayType(DoubleType())))


def cascade(
    df: DataFrame, cheap: Scorer, strong: Scorer, low: float, high: float, out: str = "scores"
) -> DataFrame:
    """Rows whose cheap top score lies in ``[low, high)`` go to the strong scorer.

    A column scorer gets the text masked to the uncertain rows, in the same scan.  Any other
    scorer gets them by filter, so a model never sees the rows that are already decided.
    """
    first = cheap(df).withColumn("_top", F.array_max(out))
    sure = (F.col("_top") < low) | (F.col("_top") >= high)
    if isinstance(strong, ColumnScorer):
        second = strong.expr(F.when(~sure, F.col(strong.text)))
        return (
            first.withColumn("_second", second)
            .withColumn("stage", F.when(sure, "cheap").otherwise("strong"))
            .withColumn(out, F.when(sure, F.col(out)).otherwise(F.col("_second")))
            .drop("_top", "_second")
        )
    kept = first.filter(sure).drop("_top").withColumn("stage", F.lit("cheap"))
    rest = strong(first.filter(~sure).drop("_top", out)).withColumn("stage", F.lit("strong"))
    return kept.unionByName(rest)


def moderated(df: DataFrame, scores: str = "scores", gate: Column | None = None) -> DataFrame:
    """Score columns of a result row: categories, overall, severity, toxic flag, action."""
    gated = S.gate(F.col(scores), gate) if gate is not None else F.col(scores)
    out = df.withColumn("categories", S.categories(gated))
    out = out.withColumn("overall_score", S.overall(F.col("categories")))
    return (
        out.withColumn("severity", S.severity(F.col("overall_score")))
        .withColumn("is_toxic", S.is_toxic(F.col("overall_score")))
        .withColumn("status", S.action(F.col("severity")))
    )


def normalised(df: DataFrame, text: str = "text", compose: bool = True) -> DataFrame:
    return df.withColumn("normalized", T.normalize_for_toxicity(F.col(text), compose=compose))


def with_offline_default(messages: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Messages the scorer returned nothing for become SAFE with score 0."""
    joined = messages.join(results, key, "left")
    return (
        joined.withColumn("model_version", F.coalesce("model_version", F.lit(k.OFFLINE_VERSION)))
        .withColumn("overall_score", F.coalesce("overall_score", F.lit(0.0)))
        .withColumn("severity", F.coalesce("severity", F.lit("SAFE")))
        .withColumn("is_toxic", F.coalesce("is_toxic", F.lit(False)))
    )
