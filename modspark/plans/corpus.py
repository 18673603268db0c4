"""Raw labelled sources to one deduplicated, split corpus; rewrite-pair curation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark import constants as k
from modspark import fixed_values as fv
from modspark.functions import lang as L
from modspark.functions import text as T
from modspark.operators import tables

ROW_BITS = 44


def _project(df: DataFrame, text: Column, source: Column, labels: Mapping[str, Column]) -> DataFrame:
    zero = F.lit(0)
    return df.select(
        text.alias("text"),
        source.alias("source_language"),
        *[labels.get(t, zero).cast("int").alias(t) for t in k.LABELS],
        *[c for c in ("row_idx",) if c in df.columns],
    )


def from_comments(df: DataFrame, source: str = "english (comments)") -> DataFrame:
    """Comments with six labels: rename and tag the source."""
    renamed = df.withColumnRenamed("comment_text", "text")
    return _project(renamed, F.col("text"), F.lit(source), {t: F.col(t) for t in k.LABELS})


def from_binary(df: DataFrame, default_language: str = "hinglish") -> DataFrame:
    """Binary label to toxic and insult; identity hate only for Hinglish sources."""
    language = (
        F.coalesce(F.col("lang"), F.lit(default_language)) if "lang" in df.columns else F.lit(default_language)
    )
    on = F.coalesce(F.col("label") == 1, F.lit(False))
    return _project(
        df,
        F.col("text"),
        language,
        {
            "toxic": on,
            "insult": on,
            "identity_hate": on & F.lower(language).contains("hinglish"),
        },
    )


def from_classes(df: DataFrame, source: str = "hindi/hinglish (classes)") -> DataFrame:
    """Class codes to labels; cleaned text first, raw text where it is missing."""
    raw = F.col("rawtweets") if "rawtweets" in df.columns else F.lit("")
    hof = F.coalesce(F.upper("binary class") == "HOF", F.lit(False))
    context = F.coalesce(F.upper("Context class"), F.lit(""))
    return _project(
        df,
        F.coalesce(F.col("cleaned Tweets"), raw),
        F.lit(source),
        {
            "toxic": hof,
            "obscene": context == "PRFN",
            "insult": (context == "OFFN") | hof,
            "identity_hate": context == "HATE",
        },
    )


def usable_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Stripped texts longer than one character; nulls are dropped."""
    return df.withColumn(text, T.strip(F.col(text))).filter(F.length(text) > 1)


def unify(sources: Sequence[DataFrame]) -> DataFrame:
    """Concatenate the sources, strip, and keep the first row of each text.

    Every source carries ``row_idx``; source rank and row index make one integer order,
    so the first occurrence is an aggregate and not a sort.
    """
    ranked = [
        s.withColumn("row_order", F.shiftleft(F.lit(i).cast("long"), ROW_BITS) + F.col("row_idx"))
        for i, s in enumerate(sources)
    ]
    whole = reduce(lambda a, b: a.unionByName(b), ranked).drop("row_idx")
    return tables.keep_first(usable_text(whole), F.col("text"), "row_order")


def prepare(
    sources: Sequence[DataFrame], seed: int = 42, strata: Sequence[str] = tuple(k.LABELS)
) -> DataFrame:
    """Unified corpus with ``fold`` and ``split``."""
    return tables.stratified_split(unify(sources), strata, seed, "row_order")


def curation_candidates(df: DataFrame, toxic: Column, text: str = "text") -> DataFrame:
    """Toxic, no Devanagari, short enough to rewrite by hand rules."""
    return df.filter(
        toxic & ~L.has_devanagari(F.col(text)) & (F.length(text) < fv.PLAIN_SCRUB_MAX_CHARS)
    )


def real_pairs(df: DataFrame, toxic: Column, n: int, seed: int, row_id: str, text: str = "text") -> DataFrame:
    picked = tables.sample_n(curation_candidates(df, toxic, text), n, seed, row_id)
    return picked.select(
        row_id,
        T.strip(F.col(text)).alias("toxic_text"),
        T.simple_scrub(F.col(text)).alias("clean_text"),
    )


def _pick(seed: str, row: Column, size: Column | int) -> Column:
    """Seeded position below ``size`` for a row."""
    h = F.md5(F.concat_ws("|", F.lit(seed), row.cast("string")))
    n = size if isinstance(size, Column) else F.lit(size)
    return F.pmod(F.conv(F.substring(h, 1, 7), 16, 10).cast("long"), n).cast("int")


def synthetic_pairs(
    rows: DataFrame, row_id: str, categories: Sequence[Mapping], seed: int = 42, paired: bool = True
) -> DataFrame:
    """One template pair per row of ``rows``.

    ``categories``: dicts with ``type``, ``templates`` and ``clean`` (parallel lists) and
    ``slots`` (name -> values).  ``paired`` takes the clean text of the same template and
    fills slots on both sides; otherwise the clean text is drawn on its own and keeps its
    slots, as an option for parity.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(c["type"]).alias("type"),
                F.array(*[F.lit(t) for t in c["templates"]]).alias("templates"),
                F.array(*[F.lit(t) for t in c["clean"]]).alias("clean"),
            )
            for c in categories
        ]
    )
    key = F.col(row_id)
    out = rows.select(row_id, _pick(f"{seed}c", key, len(categories)).alias("_ci"))
    out = out.withColumn("_c", F.get(table, F.col("_ci")))
    out = out.withColumn("_ti", _pick(f"{seed}t", key, F.size("_c.templates")))
    clean_at = F.col("_ti") if paired else _pick(f"{seed}p", key, F.size("_c.clean"))
    toxic, clean = F.get("_c.templates", F.col("_ti")), F.get("_c.clean", clean_at)
    for i, c in enumerate(categories):
        for slot, values in c.get("slots", {}).items():
            words = F.array(*[F.lit(v) for v in values])
            value = F.get(words, _pick(f"{seed}{slot}", key, len(values)))
            mark = F.lit("{" + slot + "}")
            toxic = F.when(F.col("_ci") == i, F.replace(toxic, mark, value)).otherwise(toxic)
            if paired:
                clean = F.when(F.col("_ci") == i, F.replace(clean, mark, value)).otherwise(clean)
    return out.select(
        row_id, F.col("_c.type").alias("category"), toxic.alias("toxic_text"), clean.alias("clean_text")
    )


def curated_set(synthetic: DataFrame, real: DataFrame, seed: int, row_id: str) -> DataFrame:
    """Both kinds of pairs in seeded order."""
    both = synthetic.select(row_id, "toxic_text", "clean_text", F.lit("synthetic").alias("kind")).unionByName(
        real.select(row_id, "toxic_text", "clean_text", F.lit("real").alias("kind"))
    )
    h = tables.seeded_hash(seed, F.col("kind"), F.col(row_id))
    return both.orderBy(h)
