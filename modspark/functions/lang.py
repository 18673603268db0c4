"""Script profile and language rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modspark import fixed_values as fv
from modspark.functions.text import WS, bind, has_rare_ws, strip, tokens

ANY_INDIAN = "[\\u0900-\\u0D7F]"


def count_in(c: Column, char_class: str) -> Column:
    """Characters of a class, by what is left when its runs are removed."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{char_class}]+", ""))


def script_counts(c: Column) -> Column:
    """Struct of characters per script; the nine blocks are counted on the Indic letters of the text only."""
    letters = F.coalesce(F.regexp_replace(c, f"[^{ANY_INDIAN[1:]}+", ""), F.lit(""))
    blocks = [(name, block) for name, block, _ in fv.SCRIPT_BLOCKS]
    return bind(
        letters,
        lambda v: F.struct(
            *[F.when(v == "", 0).otherwise(count_in(v, block)).alias(name) for name, block in blocks], count_in(c, "a-zA-Z").alias("latin")
        ),
    )


def dominant_language(counts: Column) -> Column:
    """Language of the largest block, the earlier one on ties."""
    ranked = F.array(
        *[
            F.struct(
                counts[name].alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")
            )
            for i, (name, _, code) in enumerate(fv.SCRIPT_BLOCKS)
        ]
    )
    return F.array_max(ranked)["code"]


def distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def romanised_hits(c: Column, words: Sequence[str] = tuple(fv.ROMANISED_HINDI)) -> Column:
    """How many distinct tokens are indicator words."""
    found = lambda not_ws: F.regexp_extract_all(F.lower(c), F.lit(whole_tokens(words, not_ws)), F.lit(1))
    return F.size(F.array_distinct(F.when(has_rare_ws(c), found(f"[^{WS}]")).otherwise(found("\\S"))))


def whole_tokens(words: Sequence[str], not_ws: str) -> str:
    """Pattern of words that stand between white space."""
    return f"(?<!{not_ws})({'|'.join(map(re.escape, words))})(?!{not_ws})"


def romanised_language(c: Column, fallback: Column | None = None) -> Column:
    """Two indicator words, or one in at most five distinct tokens, mean Hinglish."""
    rest = F.coalesce(fallback, F.lit("en")) if fallback is not None else F.lit("en")
    rest = F.when(rest == "hi", "hi-en").otherwise(rest)
    enough = bind(romanised_hits(c), lambda n: (n >= 2) | ((n >= 1) & (F.size(distinct_tokens(c)) <= 5)))
    return F.when(enough, "hi-en").otherwise(rest)


def detect_language(c: Column, fallback: Column | None = None) -> Column:
    """Script first, romanised indicator words second, then ``fallback`` (a column
    of another detector, ``en`` when absent)."""
    t = F.coalesce(c, F.lit(""))
    counts = script_counts(t)
    return (
        F.when(strip(t) == "", "en")
        .when(t.rlike(ANY_INDIAN), bind(counts, _by_script))
        .when(t.rlike("[a-zA-Z]"), romanised_language(t, fallback))
        .otherwise("en")
    )


def _by_script(counts: Column) -> Column:
    indian = sum((counts[name] for name, _, _ in fv.SCRIPT_BLOCKS), F.lit(0))
    latin = counts["latin"]
    mixed = latin / (latin + indian) > fv.LATIN_SHARE_MIXED
    return bind(
        dominant_language(counts),
        lambda code: F.when(mixed & (code == "hi"), "hi-en").when(mixed, "indic-en").otherwise(code),
    )


def is_indian_language(code: Column) -> Column:
    return F.coalesce(code.isin(fv.INDIAN_CODES), F.lit(False))


def has_devanagari(c: Column) -> Column:
    return F.coalesce(c.rlike("[\\u0900-\\u097F]"), F.lit(False))


def devanagari_share(c: Column) -> Column:
    """Devanagari letters over all letters; combining vowel signs are not letters."""
    letters = count_in(c, "\\p{L}")
    dev = count_in(c, "\\u0900-\\u097F&&\\p{L}")
    return F.when(letters > 0, dev / letters).otherwise(F.lit(0.0))


def is_devanagari_text(c: Column) -> Column:
    return devanagari_share(c) > fv.DEVANAGARI_SHARE


def char_classes(c: Column) -> Column:
    """Characters per text: ASCII, Devanagari, total."""
    return F.struct(
        F.when(F.octet_length(c) == F.length(c), F.length(c))
        .otherwise(count_in(c, "\\x00-\\x7F"))
        .alias("ascii"),
        F.when(c.rlike("[\\u0900-\\u097F]"), count_in(c, "\\u0900-\\u097F")).otherwise(0).alias("devanagari"),
        F.length(c).alias("total"),
    )
