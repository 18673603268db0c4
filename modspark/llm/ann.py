"""Nearest neighbours by inner product over randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.llm.common import stored

SAMPLE = 10_000
QUERY_BLOCK = 20_000
QUERY_BITS = 8
SURE = 3.0  # width of the error bounds: a vector is overlooked if its error is beyond it
CHUNK = 128


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix from ``dim`` to the next multiple of 64 dimensions; always the same."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(20_240_521 + wide).normal(size=(wide, wide)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors that aren't null, empty or zero and hold finite numbers only; ids that aren't null."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).where(F.exists("v", lambda x: x != 0))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, for each number of dimensions."""
    v = batch.column("v")
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield ids[rows], flat[start[rows][:, None] + np.arange(dim)]


def encode(v: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated differences from the centre, their lengths, and the inner product of
    each unit difference with its code."""
    d = (v - center) @ rotation(v.shape[1]).T
    radius = np.sqrt((d * d).sum(1))
    wide = d.shape[1]
    along = np.abs(d).sum(1) / np.sqrt(wide) / np.where(radius > 0, radius, 1)
    return np.packbits(d > 0, axis=1, bitorder="little").view(np.uint64), radius, np.where(radius > 0, along, 1.0)


def bounds(code: np.ndarray, radius: np.ndarray, along: np.ndarray, queries: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products (queries x vectors), and how far off they may be.

    A rotated query is rounded to 8 bits a dimension; bit plane by bit plane its product with the
    codes is a count of common bits.
    """
    q = queries @ rotation(queries.shape[1]).T
    wide = q.shape[1]
    low = q.min(1)
    step = np.maximum(q.max(1) - low, 1e-300) / (2**QUERY_BITS - 1)
    u = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint32)
    common = np.zeros((len(q), len(code)), np.int32)
    for j in range(QUERY_BITS):
        plane = np.packbits((u >> np.uint32(j)) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(code.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & code[:, w]).astype(np.int32) << j
    ones = np.bitwise_count(code).sum(1)
    product = 2 * low[:, None] * ones + 2 * step[:, None] * common - (wide * low + step * u.sum(1))[:, None]
    scale = radius / (along * math.sqrt(wide))
    off = SURE * np.sqrt(np.maximum(1 - along**2, 0)) / along * radius / math.sqrt(max(wide - 1, 1))
    rounding = step[:, None] * scale * math.sqrt(wide / 12) * SURE
    length = np.sqrt((q * q).sum(1))[:, None]
    return (queries @ center)[:, None] + product * scale, length * off + rounding + 1e-9 * length * (radius + 1)


def _search(ids: np.ndarray, queries: dict[int, tuple[np.ndarray, np.ndarray]], centers: dict[int, np.ndarray], k: int):
    """Each query's ``k`` best of a partition: codes choose, exact products decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf)
        who = np.full((len(ids), k), -1, np.int64)
        for batch in batches:
            for own, v in _by_dim(batch):
                if v.shape[1] not in queries:
                    continue
                rows, q_all = queries[v.shape[1]]
                center = centers[v.shape[1]]
                code, radius, along = encode(v, center)
                for a in range(0, len(rows), CHUNK):
                    at = rows[a : a + CHUNK]
                    est, off = bounds(code, radius, along, q_all[a : a + CHUNK], center)
                    mine = ids[at][:, None] == own
                    least = np.where(mine, -np.inf, est - off)
                    most = np.where(mine, -np.inf, est + off)
                    floor = np.partition(least, len(own) - k, 1)[:, len(own) - k] if len(own) > k else np.full(len(at), -np.inf)
                    floor = np.maximum(floor, best[at, k - 1])
                    for i, r in enumerate(at.tolist()):
                        c = np.flatnonzero((most[i] >= floor[i]) & ~mine[i])
                        if not len(c):
                            continue
                        score = np.append(best[r], (v[c] * q_all[a + i]).sum(1))
                        name = np.append(who[r], own[c])
                        o = np.lexsort((name, -score))[:k]
                        best[r], who[r] = score[o], name[o]
        r, c = np.nonzero(best > -np.inf)
        for x in range(0, len(r), 50_000):
            a, b = r[x : x + 50_000], c[x : x + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(who[a, b]), pa.array(best[a, b])], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` vectors of the largest inner product for each query: ``query_id, rank, vec_id, score``.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. Every usable vector is coded and
    compared; one with the query's own id is left out. A query with fewer candidates returns all
    of them; ties go to the smaller vec_id. Vectors that are null, zero, or hold null or
    non-finite numbers take no part, neither do null ids; vectors meet those of their own number of
    dimensions only. Rows repeated among the vectors are candidates each; of several queries with one
    id the least counts. Empty tables give no rows. Other columns are ignored.

    Codes are taken from a centre, the mean of at most ``sample`` vectors (first by a hash of
    vec_id). Queries go in blocks of about ``query_block``, each sent to all tasks, so what is
    broadcast is bounded; vectors stay where they are. Of its vectors a task sends on ``k`` a query.
    """
    spark = vectors.sparkSession
    base = stored(usable(vectors), "vectors")
    sums: dict[int, list[np.ndarray]] = {}
    for r in base.orderBy(F.xxhash64("vec_id"), "v").limit(sample).collect():
        sums.setdefault(len(r["v"]), []).append(np.array(r["v"]))
    asked = stored(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        dims: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            dims.setdefault(len(r["v"]), []).append(i)
        sets = {d: (np.array(own), np.array([rows[i]["v"] for i in own])) for d, own in dims.items()}
        centers = {d: np.mean(sums[d], 0) if d in sums else np.zeros(d) for d in sets}
        found = base.mapInArrow(_search(ids, sets, centers, k), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
