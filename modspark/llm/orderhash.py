"""Document fingerprints by Order MinHash: minimal numbered k-mers, in the order of the text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.llm.common import stored, texts_of
from modspark.llm.minhash import mixed

K = 8  # code points of a k-mer
L = 2  # k-mers of a tuple
M = 64  # tuples of a fingerprint, 32 bits each
EXPECTED = 10  # k-mers a function finds below its first limit, on the average
BLOCK = 2048

U64 = np.uint64
_MULTIPLY, _OCCURRENCE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_FUNCTIONS = mixed(np.arange(1, M + 1, dtype=U64)) | U64(1)
_ODD = (_FUNCTIONS >> U64(32)).astype(np.uint32) | np.uint32(1)
_EMPTY = np.zeros(M, np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def kmers(codes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` code points, and of each run with its number among equal ones before it.
    Fewer code points are one run."""
    n = max(1, len(codes) - k + 1)
    h = np.full(n, U64(min(len(codes), k)))
    wide = codes.astype(U64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(codes))):
            h = h * _MULTIPLY + wide[j : j + n]
        h = mixed(h)
        # Places in the low bits: one plain sort brings equal runs together in text order.
        low = U64((1 << n.bit_length()) - 1)
        line = np.sort(h & ~low | np.arange(n, dtype=U64))
        at, run = (line & low).astype(np.int64), line & ~low
        index = np.arange(n)
        start = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), index, 0))
        number = np.empty(n, U64)
        number[at] = (index - start).astype(U64)
        return h, mixed(h + number * _OCCURRENCE)


def _least(numbered: np.ndarray, l: int) -> np.ndarray:
    """For each function the places of its ``l`` least values, in text order.

    A value is the product of the upper 32 bits with the function's odd number, modulo 2^32; equal values
    go by all 64 bits. Only values below a limit are looked at, and where that leaves a function with too
    few, all.
    """
    n = len(numbered)
    upper = (numbered >> U64(32)).astype(np.uint32)
    if n <= 4 * EXPECTED:
        value = _ODD[:, None] * upper
        order = np.lexsort((np.broadcast_to(numbered, value.shape), value))
        return np.sort(order[:, :l], axis=1)
    limit = np.uint32(EXPECTED * 2**32 // n + 1)
    value, below = np.empty((M, BLOCK), np.uint32), np.empty((M, BLOCK), bool)
    found = []
    for i in range(0, n, BLOCK):
        part = upper[i : i + BLOCK]
        v = np.multiply(_ODD[:, None], part, out=value[:, : len(part)])
        at = np.flatnonzero(np.less(v, limit, out=below[:, : len(part)]))
        f = at // len(part)
        found.append((f, at + (i - f * len(part)), v.ravel()[at] if len(part) == BLOCK else _ODD[f] * part[at - f * len(part)]))
    f, p, v = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    key = f.astype(U64) << U64(32) | v
    order = np.argsort(key)
    if (key[order[1:]] == key[order[:-1]]).any():
        order = np.lexsort((numbered[p], key))
    f, p = f[order], p[order]
    count = np.bincount(f, minlength=M)
    first = np.cumsum(count) - count
    out = p[np.minimum(first[:, None] + np.arange(l), len(p) - 1)]
    for j in np.flatnonzero(count < l):
        out[j] = np.lexsort((numbered, _ODD[j] * upper))[:l]
    return np.sort(out, axis=1)


def order_minhash(codes: np.ndarray, k: int = K, l: int = L) -> np.ndarray:
    """``M`` hashes of 32 bits. Each of ``M`` functions picks the ``l`` least of the numbered k-mers; these are
    hashed in the order in which the text has them. A text without code points has zeros."""
    if not len(codes):
        return _EMPTY
    h, numbered = kmers(codes, k)
    chosen = h[_least(numbered, l)]
    out = _FUNCTIONS.copy()
    with np.errstate(over="ignore"):
        for j in range(chosen.shape[1]):
            out = mixed(out * _MULTIPLY + chosen[:, j])
    return np.maximum(out >> U64(32), 1).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes: 1 for equal texts; the less, the farther apart by edits and moves."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE, _TAIL, _HEAD = 0, 1, 2
_NAMES = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next", "text"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
_SCHEMA = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double, text string"


def _raw(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u4").tobytes()


def _compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = own if new == text else order_minhash(code_points(new))
    sha = hashlib.sha256(new.encode()).hexdigest()
    return doc_id, len(text), sha, _raw(own), _raw(changed), likeness(own, changed), likeness(own, other)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its partition. The first and the last go out as they are, to be told
    of the partitions beside."""
    part = TaskContext.get().partitionId()
    last: tuple | None = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            own = order_minhash(code_points(text)) if last is None or text != last[1] else last[2]
            if last is None:
                out.append((_HEAD, part, doc_id, len(text), None, _raw(own), None, None, None, text))
            else:
                out.append((_DONE, part, *_compared(*last, text, own), None))
            last = (doc_id, text, own)
        if out:
            yield _batch(out)
    if last is not None:
        doc_id, text, own = last
        yield _batch([(_TAIL, part, doc_id, len(text), None, _raw(own), None, None, None, text)])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for part, doc_id, text, own, following, other in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "print", "following", "other")), strict=True):
            a, b = (np.frombuffer(x, ">u4").astype(np.uint32) for x in (own, other))
            out.append((_DONE, part, *_compared(doc_id, text, a, following, b), None))
        if out:
            yield _batch(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint`` of every text; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [order_minhash(code_points(t.as_py() or "")).astype(">u4").tobytes().hex() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], ["doc_id", "text", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, text string, fingerprint string")


def with_edited(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the
    next document's. Documents go by descending doc_id, null ids last, equal ids by a hash of the text
    and then as they were read; after the last comes the first, so one document alone follows itself.
    A null text is empty. Equal texts have equal fingerprints, empty ones zeros; likeness is the share
    of equal hashes. An empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.

    Texts are dealt by ranges of that order once and stream past; of each range only the first and
    the last row are joined with their neighbours' (a row for each partition, whatever the input).
    """
    rows = texts_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("same", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("same"), F.col("nth")]
    line = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = stored(line.mapInArrow(_followed, _SCHEMA), "prints")
    ends = done.where(F.col("kind") != _DONE)
    heads = ends.where(F.col("kind") == _HEAD)
    # One row for each partition that has documents.
    places = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    beside = heads.select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("print").alias("other"))
    tails = ends.where(F.col("kind") == _TAIL).select("part", "doc_id", "text", "print").join(places, "part").join(beside, "next")
    closed = tails.select("part", "doc_id", "text", "print", "following", "other").mapInArrow(_closed, _SCHEMA)
    out = done.where(F.col("kind") == _DONE).union(closed)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
