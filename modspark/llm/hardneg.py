"""Hard negatives: exact integer products by Strassen's recursion on tiles, and heaps that merge."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspark.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
LEAF = 32
TILE_ANCHORS, TILE_ROWS = 256, 4096
BLOCK_BYTES = 16_000_000  # of anchors that are sent to all tasks at once
SMALLEST, LARGEST = -(2**63), 2**63 - 1


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact; by floating point where every partial sum is below 2^53 and so an exact double."""
    if a.dtype == np.int64 and a.size and b.size:
        largest = a.shape[1] * max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min()))
        if largest < 2**53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by seven products of quarters. Odd sides are padded with zeros.

    Numbers of 64 bits wrap around, in sums and products alike, so a result that fits is exact
    whatever happened on the way.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return leaf_product(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), a.dtype)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integers(v: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` as int64, or as Python integers where one does not fit."""
    if not v.size or np.abs(v).max() < 2**62 / SCALE:
        return np.floor(v * SCALE).astype(np.int64)
    out = np.empty(v.shape, object)
    out.ravel()[:] = [math.floor(x * SCALE) if abs(x) < 2**50 else int(x) * SCALE for x in v.ravel().tolist()]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as int64; one that is beyond a long counts as the nearest long."""
    if a.dtype == b.dtype == np.int64 and a.size and b.size:
        if a.shape[1] * max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) <= LARGEST:
            return strassen(a, b.T)
    elif not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.minimum(np.maximum(exact, SMALLEST), LARGEST).astype(np.int64)


class Heaps:
    """The first ``k`` (score, id) of each slot, best first; ties go to the smaller id. Heaps of parts merge."""

    def __init__(self, slots: int, k: int):
        self.score = np.zeros((slots, k), np.int64)
        self.name = np.zeros((slots, k), np.int64)
        self.count = np.zeros(slots, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, names: np.ndarray, fits: np.ndarray) -> None:
        """Rows of ``scores`` for ``slots``; ``names`` rise along the columns; only those that ``fits`` marks count."""
        k = self.score.shape[1]
        full = self.count[slots] == k
        # What is not above a full heap's least can only tie with it.
        fits = fits & (~full[:, None] | (scores >= self.score[slots, k - 1][:, None]))
        row, col = np.nonzero(fits)
        if not len(row):
            return
        held = np.arange(k) < self.count[slots][:, None]
        old_row, old_col = np.nonzero(held)
        at = np.append(row, old_row)
        score = np.append(scores[row, col], self.score[slots[old_row], old_col])
        name = np.append(names[col], self.name[slots[old_row], old_col])
        # ~score turns the order round without leaving 64 bits.
        order = np.lexsort((name, ~score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < k
        order, at, rank = order[first], at[first], rank[first]
        self.score[slots[at], rank] = score[order]
        self.name[slots[at], rank] = name[order]
        self.count[slots] = np.bincount(at, minlength=len(slots))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, col = np.nonzero(np.arange(self.score.shape[1]) < self.count[:, None])
        return slot, self.score[slot, col], self.name[slot, col]


@dataclass
class Anchors:
    """Anchors of one number of dimensions, in order of their ids."""

    name: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    slot: np.ndarray  # place in the block


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows with an id, a label and a vector whose numbers are all there and finite."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and label is not null and v is not null").where(finite)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids (rising), labels and vectors of one number of dimensions, some thousand rows at a time."""
    for batch in batches:
        v = batch.column("v")
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            own = own[np.argsort(ids[own], kind="stable")]
            for i in range(0, len(own), TILE_ROWS):
                rows = own[i : i + TILE_ROWS]
                yield ids[rows], label[rows], integers(flat[start[rows][:, None] + np.arange(dim)])


def _positives(block: dict[int, Anchors], n: int, k: int):
    """Each anchor's first ``k`` other rows of its label in a part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n, k)
        for ids, label, rows in _tiles(batches):
            own = block.get(rows.shape[1])
            if own is None:
                continue
            for value in np.intersect1d(own.label, label).tolist():
                c, every = label == value, np.flatnonzero(own.label == value)
                for i in range(0, len(every), TILE_ANCHORS):
                    a = every[i : i + TILE_ANCHORS]
                    heaps.offer(own.slot[a], products(own.vector[a], rows[c]), ids[c], own.name[a][:, None] != ids[c])
        slot, score, name = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(name), pa.array(score)], ["slot", "vec_id", "score"])

    return run


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The integers s with low * score <= 100 * s <= high * score: first and last (none where they cross)."""
    return -(-low * score // 100), high * score // 100


def _negatives(block: dict[int, Anchors], n: int, spans: np.ndarray, k: int):
    """For each anchor and positive the first ``k`` rows of other labels whose score lies in the window.

    ``spans``: slot x positive x (first, last); without a positive, first > last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = spans.shape[1]
        heaps = Heaps(n * places, k)
        for ids, label, rows in _tiles(batches):
            own = block.get(rows.shape[1])
            if own is None:
                continue
            for i in range(0, len(own.name), TILE_ANCHORS):
                a = slice(i, i + TILE_ANCHORS)
                scores = products(own.vector[a], rows)
                other = (own.label[a][:, None] != label) & (own.name[a][:, None] != ids)
                for p in range(places):
                    span = spans[own.slot[a], p]
                    fits = other & (scores >= span[:, :1]) & (scores <= span[:, 1:])
                    heaps.offer(own.slot[a] * places + p, scores, ids, fits)
        slot, score, name = heaps.rows()
        cols = [pa.array(slot // places, pa.int32()), pa.array(slot % places, pa.int32()), pa.array(name), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cols, ["slot", "place", "vec_id", "score"])

    return run


def _firsts(rows: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """Heaps of all parts merged: the first ``k`` of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    another label whose score is ``low`` to ``high`` percent of the positive's.

    Both tables have ``vec_id, label, embedding``. Components become ``floor(256 * x)``; a score is the
    exact integer inner product with the anchor. Higher scores come first, ties by smaller vec_id. Returns
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part;
    rows meet rows of their own number of dimensions. A row with the anchor's id is the anchor; of
    anchors that share an id the least by label and vector counts. Repeated rows are rows each. A score beyond a
    long counts as the nearest long. Empty tables give no rows; other columns are ignored.

    The products of all anchors and rows are the work. Anchors are taken to the driver in blocks of about
    ``block_bytes``, one at a time, and sent to all tasks; a task keeps heaps of fixed size for the rows
    it reads, whichever these are, and what a block gives is written before the next begins.
    """
    spark = vectors.sparkSession
    base = stored(usable(vectors), "vectors")
    asked = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    asked = stored(asked.select("vec_id", "a.label", "a.v"), "anchors")
    n, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n * (8 * (wide or 0) + 64) / block_bytes)) if n else 0
    out = spark.createDataFrame([], _OUT)
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if own:
            found = _block(base, own, positives, negatives, low, high)
            out = found if blocks == 1 else out.union(stored(found, "negatives"))
    return out


def _block(base: DataFrame, own: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = base.sparkSession
    dims: dict[int, list[int]] = {}
    for i, r in enumerate(own):
        dims.setdefault(len(r["v"]), []).append(i)
    block = {}
    for dim, at in dims.items():
        v = integers(np.array([own[i]["v"] for i in at], np.float64).reshape(len(at), dim))
        block[dim] = Anchors(np.array([own[i]["vec_id"] for i in at]), np.array([own[i]["label"] for i in at]), v, np.array(at))
    first = base.mapInArrow(_positives(block, len(own), positives), "slot int, vec_id long, score long")
    first = stored(_firsts(first, ["slot"], positives, "place"), "positives")
    spans = np.tile(np.array([1, 0], np.int64), (len(own), positives, 1))
    for r in first.select("slot", "place", "score").collect():
        lo, hi = window(r["score"], low, high)
        spans[r["slot"], r["place"] - 1] = (max(lo, SMALLEST), hi) if lo <= hi else (1, 0)
    found = base.mapInArrow(_negatives(block, len(own), spans, negatives), "slot int, place int, vec_id long, score long")
    found = _firsts(found, ["slot", "place"], negatives, "rank")
    names = spark.createDataFrame([(i, r["vec_id"]) for i, r in enumerate(own)], "slot int, anchor_id long")
    told = first.select("slot", (F.col("place") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(told, ["slot", "place"]).join(names, "slot")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def moved_label() -> Column:
    """(label + 1) % 10 where vec_id is divisible by 7, else label."""
    label = F.col("label").cast("decimal(38,0)")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).cast("long")


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives for the rows of ``embeddings`` whose vec_id is divisible by 50, with moved labels."""
    rows = embeddings.select("vec_id", moved_label().alias("label"), "embedding")
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))
