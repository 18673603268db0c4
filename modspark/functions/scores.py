"""Score rules: lexicon points, gate, severity, action, tag lists."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions.maths import fixed, round_exact
from modspark.functions.text import whole_words
from modspark.lexicon import HALF_POINT, default_lexicon

MAX_INLINE_TERMS = 2000


def lexicon_hits(c: Column, terms: Sequence[str]) -> Column:
    """Every whole-word occurrence of a term, in text order."""
    if len(terms) > MAX_INLINE_TERMS:
        raise ValueError("use operators.scoring.term_table_scorer for large term tables")
    longest_first = sorted(terms, key=lambda t: (-len(t), t))
    pattern = whole_words("|".join(re.escape(t) for t in longest_first))
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def lexicon_points(c: Column, lexicon: Mapping[str, Sequence[int]] | None = None) -> Column:
    """Summed integer weights per label over all occurrences.

    The text is scanned once; the fold runs over the matches only.
    """
    lexicon = lexicon or default_lexicon()
    zeros = F.array(*[F.lit(0)] * len(k.LABELS))
    weights = {t: [int(w) for w in ws] for t, ws in lexicon.items()}
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<int>>")  # a constant
    return F.aggregate(
        lexicon_hits(c, list(lexicon)),
        zeros,
        lambda acc, term: F.zip_with(acc, F.element_at(table, term), lambda a, b: a + b),
    )


def points_to_scores(points: Column) -> Column:
    return F.transform(points, lambda p: round_exact(p / (p + HALF_POINT), 4))


def lexicon_scores(c: Column, lexicon: Mapping[str, Sequence[int]] | None = None) -> Column:
    """Six scores in label order for a lower-cased, normalised text."""
    return points_to_scores(lexicon_points(c, lexicon))


def lexicon_scores_in_context(
    message: Column, context: Column, lexicon: Mapping[str, Sequence[int]] | None = None, part: int = 4
) -> Column:
    """Scores of a message after its context: what the context raises counts a ``part``-th, rounded down.

    A null message has null scores; a null context adds nothing.
    """
    before = lexicon_points(F.coalesce(context, F.lit("")), lexicon)
    both = F.zip_with(lexicon_points(message, lexicon), before, lambda a, b: a + F.floor(b / part).cast("int"))
    return points_to_scores(both)


def gate(scores: Column, g: Column) -> Column:
    """Second opinion ``g``: pull confident scores down or lift the first label."""
    top = F.array_max(scores)
    lowered = F.transform(scores, lambda s: F.least(s, g * k.GATE_FACTOR))
    lifted = F.concat(
        F.array(F.greatest(scores[0], g)), F.slice(scores, 2, len(k.LABELS) - 1)
    )
    return (
        F.when(g.isNull(), scores)
        .when((g < k.GATE_LOW) & (top >= k.CUT_LOW), lowered)
        .when((g >= k.GATE_HIGH) & (top < k.CUT_LOW), lifted)
        .otherwise(scores)
    )


def gate_score(probabilities: Column) -> Column:
    """Toxic probability of a binary gate, 0.5 for any other shape."""
    return F.when(F.size(probabilities) == 2, F.element_at(probabilities, 2)).otherwise(F.lit(0.5))


def categories(scores: Column, digits: int = 4) -> Column:
    rounded = F.transform(scores, lambda s: round_exact(s, digits))
    return F.map_from_arrays(F.array(*[F.lit(t) for t in k.LABELS]), rounded)


def overall(cats: Column) -> Column:
    """Largest of the (already rounded) category scores."""
    return F.array_max(F.map_values(cats))


def top_tag(scores: Column, labels: Sequence[str] = tuple(k.LABELS)) -> Column:
    """Label of the largest score, the first one on ties."""
    names = F.array(*[F.lit(t) for t in labels])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def severity(score: Column) -> Column:
    return (
        F.when(score < k.CUT_LOW, "SAFE")
        .when(score < k.CUT_MEDIUM, "LOW")
        .when(score < k.CUT_HIGH, "MEDIUM")
        .otherwise("HIGH")
    )


def is_toxic(score: Column) -> Column:
    return score >= k.CUT_LOW


def action(sev: Column) -> Column:
    return (
        F.when(sev == "HIGH", k.BLOCKED).when(sev == "MEDIUM", k.FLAGGED).otherwise(k.DELIVERED)
    )


def needs_rewrite(toxic: Column, sev: Column) -> Column:
    return toxic & sev.isin("MEDIUM", "HIGH")


def route(flagged: Column, devanagari: Column) -> Column:
    return (
        F.when(~flagged, "pass").when(devanagari, "devanagari").otherwise("latin")
    )


def tag_triggers(
    scores: Column, thresholds: Mapping[str, float] | float = k.DEFAULT_TAG_THRESHOLD
) -> Column:
    """``TAG (p%)`` for every label at or over its threshold, in label order."""
    cut = {
        t: float(thresholds.get(t, k.DEFAULT_TAG_THRESHOLD))
        if isinstance(thresholds, Mapping)
        else float(thresholds)
        for t in k.LABELS
    }
    shown = [
        F.when(
            scores[i] >= cut[t],
            F.concat(F.lit(t.upper() + " ("), fixed(scores[i] * 100, 1), F.lit("%)")),
        )
        for i, t in enumerate(k.LABELS)
    ]
    return F.array_compact(F.array(*shown))


def flagged_categories(cats: Column, at_least: float = k.CUT_LOW, strict: bool = False) -> Column:
    """Map entries at or over (or strictly over) a cut."""
    return F.map_filter(cats, lambda _, v: (v > at_least) if strict else (v >= at_least))


def flagged_text(cats: Column, at_least: float = k.CUT_LOW) -> Column:
    """``label: score`` pairs by score descending, label order on ties."""
    order = F.create_map(*[x for i, t in enumerate(k.LABELS) for x in (F.lit(t), F.lit(i))])
    entries = F.transform(
        F.map_entries(flagged_categories(cats, at_least)),
        lambda e: F.struct(
            (-e["value"]).alias("desc"), F.element_at(order, e["key"]).alias("pos"),
            e["key"].alias("label"), e["value"].alias("score"),
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(entries),
            lambda e: F.concat(e["label"], F.lit(": "), fixed(e["score"], 2)),
        ),
        ", ",
    )


def binary_decision(probabilities: Column, names: Sequence[str]) -> Column:
    """Second model: toxic when the toxic class reaches one half.  The toxic class
    is found by name, else it is index 1 of two classes, else index 0."""
    lowered = [n.lower() for n in names]
    known = [i for i, n in enumerate(lowered) if n in ("toxic", "1", "label_1")]
    index = known[0] if known else (1 if len(names) == 2 else 0)
    return probabilities[index] >= 0.5
