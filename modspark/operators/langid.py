"""Language identification from character n-gram profiles, trained on a labelled table.

Weights are log probabilities in whole thousandths, so sums do not depend on the order
in which partitions are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.session import scratch_path

PROFILE_BYTES = 64 << 20
_CHUNK = 1 << 21
_DENSE = 1 << 23


def grams_of(df: DataFrame, keys: Sequence[str], text: str, n: int = 3) -> DataFrame:
    """Rows (keys, gram): every overlapping n-gram of the lower-cased whole text."""
    overlapping = F.lit(f"(?s)(?=(.{{{n}}})).")
    grams = F.regexp_extract_all(F.lower(text), overlapping, F.lit(1))
    return df.filter(F.length(text) >= n).select(*keys, F.explode(grams).alias("gram"))


def train_profiles(
    df: DataFrame, languages: Sequence[str], text: str, language: str, n: int = 3, least: int = 1
) -> DataFrame:
    """One row per gram that occurs at least ``least`` times, one weight column per language.

    Add-one smoothing inside this vocabulary. Grams of up to three characters are counted as their texts are
    read, so a task sends on a row for each of its different grams, not for each gram; the counts are stored,
    as weights and their sums both read them.
    """
    labelled = df.filter(F.col(language).isin(list(languages)))
    if n > 3:
        rows = grams_of(labelled, [language], text, n)
        wide = rows.groupBy("gram").agg(*[F.count_if(F.col(language) == l).alias(l) for l in languages])
    else:
        whole = labelled.filter(F.length(text) >= n).select(F.col(language).alias("language"), F.lower(text).alias("text"))
        schema = "gram string, " + ", ".join(f"_{i} long" for i in range(len(languages)))
        counted = whole.mapInArrow(_gram_counts(list(languages), n), schema)
        wide = counted.groupBy("gram").agg(*[F.sum(f"_{i}").alias(l) for i, l in enumerate(languages)])
        path = scratch_path(df.sparkSession, "grams")
        wide.write.parquet(path)
        wide = df.sparkSession.read.schema(wide.schema).parquet(path)
    total = reduce(lambda a, b: a + b, [F.col(l) for l in languages])
    kept = wide.filter(total >= least)
    totals = kept.agg(
        F.struct(*[F.sum(l).alias(l) for l in languages], F.count(F.lit(1)).alias("_size"))
    ).scalar()
    return kept.select(
        "gram",
        *[
            F.round(1000 * F.ln((F.col(l) + 1) / (totals[l] + totals["_size"]))).cast("long").alias(l)
            for l in languages
        ],
    )


def _packed(points: np.ndarray, n: int) -> np.ndarray:
    """One integer for every ``n`` code points in a row."""
    points = points.astype("int64")
    ids = points[: len(points) - n + 1].copy()
    for i in range(1, n):
        ids = (ids << 21) | points[i : len(points) - n + 1 + i]
    return ids


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids in order, with the sums of their counts."""
    different, place = np.unique(ids, return_inverse=True)
    out = np.zeros((len(different), counts.shape[1]), "int64")
    np.add.at(out, place, counts)
    return different, out


def _counted(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different grams of ``texts`` of ``n`` characters and more, and how often each occurs. Characters are numbered, so few
    enough of them need no sort."""
    points = _points("".join(texts))
    used = np.flatnonzero(np.bincount(points))
    ends = np.cumsum([len(t) for t in texts])[:-1]
    whole = np.ones(len(points) - n + 1, bool)
    for k in range(1, n):  # a gram does not reach into the next text
        whole[ends - k] = False
    if len(used) ** n > _DENSE:
        return np.unique(_packed(points, n)[whole], return_counts=True)
    number = np.zeros(used[-1] + 1, "int64")
    number[used] = np.arange(len(used))
    digits = number[points]
    ids = digits[: len(whole)]
    for i in range(1, n):
        ids = ids * len(used) + digits[i : len(whole) + i]
    counts = np.bincount(ids[whole])
    at = np.flatnonzero(counts)
    packed = np.zeros(len(at), "int64")
    for i in range(n):
        packed = packed << 21 | used[at // len(used) ** (n - 1 - i) % len(used)]
    return packed, counts[at]


def _strings(ids: np.ndarray, n: int) -> list[str]:
    points = np.stack([ids >> 21 * (n - 1 - k) & 0x1FFFFF for k in range(n)], 1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    return [text[i : i + n] for i in range(0, len(text), n)]


def _gram_counts(languages: list[str], n: int):
    """Batches of (language, text) to (gram, one count a language): each gram once for a few million characters."""

    def rows(ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["gram", *(f"_{i}" for i in range(len(languages)))]
        for at in range(0, len(ids), 1 << 16):
            own = counts[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(_strings(ids[at : at + (1 << 16)], n), pa.string()), *(pa.array(own[:, i]) for i in range(len(languages)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, "int64"), np.empty((0, len(languages)), "int64")
        held: list[list[str]] = [[] for _ in languages]
        size, known, sums = 0, *none

        def folded() -> tuple[np.ndarray, np.ndarray]:
            parts = [(known, sums)]
            for i, texts in enumerate(held):
                if texts:
                    ids, count = _counted(texts, n)
                    columns = np.zeros((len(ids), len(languages)), "int64")
                    columns[:, i] = count
                    parts.append((ids, columns))
                    texts.clear()
            return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) >= n:
                    held[languages.index(language)].append(text)
                    size += len(text)
                if size >= _CHUNK:
                    size, (known, sums) = 0, folded()
                    if len(known) >= _CHUNK:  # bounds what a task holds
                        yield from rows(known, sums)
                        known, sums = none
        yield from rows(*folded())

    return run


def _best(texts: list[str], grams: np.ndarray, weights: np.ndarray, n: int) -> list[int]:
    """Place of the language with the largest summed weight for each text, -1 where no gram is known."""
    sizes = np.array([max(len(t) - n + 1, 0) for t in texts], dtype="int64")
    ids = np.concatenate([_packed(_points(t), n) for t in texts if len(t) >= n] or [np.empty(0, "int64")])
    at = np.minimum(np.searchsorted(grams, ids), len(grams) - 1)
    known = grams[at] == ids
    end = np.cumsum(sizes)
    start = end - sizes
    count = np.concatenate([[0], np.cumsum(known)])
    sums = []
    for column in weights:
        total = np.concatenate([[0], np.cumsum(np.where(known, column[at], 0))])
        sums.append(total[end] - total[start])
    return np.where(count[end] > count[start], np.argmax(np.array(sums), axis=0), -1).tolist()


def predictor(
    profiles: DataFrame, languages: Sequence[str], n: int = 3, max_bytes: int = PROFILE_BYTES
) -> Callable[[Column], Column] | None:
    """``Column -> Column``: the language of a text, found in its row, with no row for each gram and no shuffle.

    Reads at most as many profile rows as fit ``max_bytes`` as a sorted table of grams and weights, which goes to
    every executor. None for a larger table, or grams over three characters: ``identify`` joins those.
    The earlier language wins ties; null where no gram is known.
    """
    bound = max_bytes // (8 * (len(languages) + 1))
    if n > 3 or not bound:
        return None
    table = profiles.select("gram", *languages).limit(bound + 1).toArrow()
    if table.num_rows > bound:
        return None
    spark = profiles.sparkSession
    grams = np.empty(0, "int64")
    if table.num_rows:
        grams = _packed(_points("".join(table["gram"].to_pylist())), n)[::n]
    order = np.argsort(grams)
    weights = np.array([table[x].to_numpy()[order] for x in languages], dtype="int64")
    model = spark.sparkContext.broadcast((grams[order], weights))
    names = [*languages, None]

    @F.pandas_udf("string")
    def predict(texts: pd.Series) -> pd.Series:
        table, columns = model.value
        given = [t if isinstance(t, str) else "" for t in texts]
        out, first, size = [], 0, 0
        for i, text in enumerate(given):  # bounds the arrays of one step
            size += len(text)
            if size >= _CHUNK or i == len(given) - 1:
                part = given[first : i + 1]
                out += _best(part, table, columns, n) if len(table) else [-1] * len(part)
                first, size = i + 1, 0
        return pd.Series([names[i] for i in out], dtype=object)

    return lambda text: predict(F.lower(text))


def identify(
    df: DataFrame, profiles: DataFrame, languages: Sequence[str], row_id: str, text: str, n: int = 3, max_bytes: int = PROFILE_BYTES
) -> DataFrame:
    """(row id, predicted): the language with the largest summed weight, the earlier
    name on ties; null when no gram is known.

    Scored in the row where the profiles pass the size check of ``predictor``. Beyond it grams of a text are
    counted and meet the profiles by a shuffled join.
    """
    in_row = predictor(profiles, languages, n, max_bytes)
    if in_row is not None:
        return df.select(row_id, in_row(F.col(text)).alias("predicted"))
    counted = grams_of(df, [row_id], text, n).groupBy(row_id, "gram").agg(F.count(F.lit(1)).alias("_n"))
    sums = counted.join(profiles, "gram").groupBy(row_id).agg(*[F.sum(F.col(l) * F.col("_n")).alias(l) for l in languages])
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(l).alias("w"), F.lit(-i).alias("o"), F.lit(l).alias("l"))
                for i, l in enumerate(languages)
            ]
        )
    )
    predicted = sums.select(row_id, best["l"].alias("predicted"))
    return df.select(row_id).join(predicted, row_id, "left")


def fallback_column(predicted: Column) -> Column:
    return F.coalesce(predicted, F.lit("en"))
