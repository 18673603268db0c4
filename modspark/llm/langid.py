"""Language identification in two steps: the family, then one-versus-one machines within it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from modspark.llm.common import texts_of

DIM = 4096
SAMPLE = 4000
UNKNOWN = "und"
SALT = 0x9E3779B1

# Language codes of the larger families. A code that is not here is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "indic": "hi ur bn pa gu mr ne sa si",
    "turkic": "tr az kk ky uz tt tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _letters(text: str) -> np.ndarray:
    """Lower-case UTF-8 bytes with one space for each run of ASCII that is no letter."""
    b = np.frombuffer(f" {text} ".lower().encode(), np.uint8)
    word = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(word, b, np.uint8(32))
    return b[np.append(True, word[1:] | word[:-1])]


def features(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors of the roots of hashed counts of 1 to 4 neighbouring bytes, over whole texts."""
    out = np.zeros((len(texts), dim), np.float32)
    shift = np.uint32(32 - (dim.bit_length() - 1))
    for i, t in enumerate(texts):
        b = _letters(t).astype(np.uint32)
        row = np.zeros(dim)
        h = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            if len(b) < n:
                break
            h = (h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            row += np.bincount(h >> shift, minlength=dim)
        row = np.sqrt(row)
        out[i] = row / max(np.sqrt(row @ row), 1e-9)
    return out


def linear_machine(x: np.ndarray, sides: Sequence[tuple[slice, int]], cost: float = 50.0, steps: int = 150) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, classes weighed alike), by accelerated descent.

    ``sides`` are runs of rows of ``x`` (its last column is 1, for the bias) with their sign. No row
    is copied, whichever machine it serves.
    """
    n = {s: sum(len(x[at]) for at, sign in sides if sign == s) for s in (-1, 1)}
    rate = 1.0 / (1.0 + 2.0 * cost * 2.0)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        grad = v.copy()
        for at, sign in sides:
            gap = np.maximum(0, 1 - sign * (x[at] @ v))
            grad -= np.float32(2 * cost * sign * 0.5 / max(n[sign], 1)) * (gap @ x[at])
        new = v - np.float32(rate) * grad
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    first: np.ndarray  # one machine for each family against the rest
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        x = np.append(x, np.ones((n, 1), np.float32), 1)
        score = x @ self.first.T * 3
        chance = np.exp(score - score.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        lang = np.empty(n, object)
        sure = chance[np.arange(n), best]
        for f in np.unique(best):
            rows, own = np.flatnonzero(best == f), self.members[self.families[f]]
            votes = np.zeros((len(rows), len(own)))
            margin = np.zeros((len(rows), len(own)))
            for i, j in itertools.combinations(range(len(own)), 2):
                p = 1 / (1 + np.exp(-3.0 * (x[rows] @ self.pairs[own[i], own[j]])))
                votes[:, i] += p > 0.5
                votes[:, j] += p <= 0.5
                margin[:, i] += p
                margin[:, j] += 1 - p
            pick = (votes + margin / max(len(own), 1) / 2).argmax(1)
            lang[rows] = np.array(own, object)[pick]
            if len(own) > 1:
                sure[rows] *= margin[np.arange(len(rows)), pick] / (len(own) - 1)
        return lang.tolist(), np.clip(sure, 0, 1)


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """All machines from one matrix, whose rows lie by language and whose last column is 1."""
    runs: dict[str, slice] = {}
    for code, own in itertools.groupby(range(len(lang)), key=lambda i: lang[i]):
        at = list(own)
        runs[code] = slice(at[0], at[-1] + 1)
    members: dict[str, list[str]] = {}
    for code in sorted(runs):
        members.setdefault(family(code), []).append(code)
    families = sorted(members)
    first = np.stack([linear_machine(x, [(at, 1 if family(c) == f else -1) for c, at in runs.items()]) for f in families])
    pairs = {(i, j): linear_machine(x, [(runs[i], 1), (runs[j], -1)]) for own in members.values() for i, j in itertools.combinations(own, 2)}
    return Model(families, members, first, pairs)


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, dim: int = DIM) -> Model | None:
    """A model of the languages in ``lang``, from ``sample`` texts at most, as many of each language as of
    any other; None where no row has a language and a text with letters.

    The sample is drawn by a hash of doc_id and text among rows that aren't held out; ties are equal rows.
    Only this sample's features and one count for each language come to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(2, sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    # A little more than needed of each, and no more than a hash order gives.
    spark = docs.sparkSession
    cut = spark.createDataFrame([(k, int(min(1.0, 1.2 * each / n + 20 / n) * 1_000_003)) for k, n in counts.items()], "lang string, cut long")
    chosen = rows.join(F.broadcast(cut), "lang").where(draw < F.col("cut")).withColumn("draw", draw)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    chosen = chosen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = features(part.column("text").to_pylist(), dim).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("nth"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "nth", "x"])

    got = chosen.select("lang", "nth", "text").mapInArrow(run, "lang string, nth int, x binary").toArrow()
    lang, nth, packed = got.column("lang").to_pylist(), got.column("nth").to_pylist(), got.column("x")
    order_ = sorted(range(len(lang)), key=lambda i: (lang[i], nth[i]))
    x = np.ones((len(order_), dim + 1), np.float32)
    for at, i in enumerate(order_):
        x[at, :dim] = np.frombuffer(packed[i].as_buffer(), np.float16)
    del got, packed
    return fit(x, [lang[i] for i in order_])


def identify(docs: DataFrame, model: Model | None, columns: Sequence[str] = ("doc_id", "text"), dim: int = DIM) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to ``columns`` of the documents; nothing is shuffled.

    A null text, one without letters (in the sense of Unicode), or no model: ``und`` with score 0. Whole texts are read.
    Columns of the names that are added are replaced.
    """
    rows = docs.select(*(c for c in columns if c not in ("lang_pred", "score"))).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if model and has_letter(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    for i, name, s in zip(known, *model.predict(features([texts[i] for i in known], dim)), strict=True):
                        lang[i], score[i] = name, float(s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``, by a model of the rows that aren't held out.

    Repeated rows and null doc_ids come back as they are (``held_out`` false for null); an empty
    table gives no rows. Only ``doc_id``, ``text`` and ``lang`` are read, and ``lang`` only to learn.
    """
    return identify(texts_of(docs), train(docs, sample)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
