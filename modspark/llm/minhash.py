"""Near-duplicates by DartMinHash signatures of weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.llm.cluster import SMALL, bucket_members, linked
from modspark.llm.common import doc_key, passing, stored, texts_of

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
REGIONS = 500_000  # of the plane, looked at together

U64 = np.uint64
NONE = U64(2**64 - 1)
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words; bounded by being emptied."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _C1
        x = (x ^ (x >> U64(30))) * _C2
        x = (x ^ (x >> U64(27))) * _C3
        return x ^ (x >> U64(31))


def word_hashes(text: str) -> np.ndarray:
    """Of the lower-case words between white space."""
    words = text.lower().split()
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))


def shingles(words: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Different runs of ``width`` words, sorted, and how often each occurs. Fewer words are one run."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(words))):
            h = h * _C2 + words[k : k + n]
    return np.unique(mixed(h), return_counts=True)


@lru_cache(8)
def _poisson(area: float) -> np.ndarray:
    """Upper ends, as 32-bit numbers, of the chances of 0, 1, 2... darts on ``area``."""
    p, total, out = np.exp(-area), 0.0, []
    for k in range(30):
        total += p
        out.append(min(total, 1.0) * 2**32)
        p *= area / (k + 1)
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) / 2**53


def _darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int):
    """Darts below each element's weight and its set's ``limit`` of ranks: set * k + coordinate, and dart.

    The plane of weights and ranks is cut into regions, weights at 1, 2, 4, 8..., and over a strip
    of width d ranks at 1/4d, 1/2d, 1/d, 2/d, 3/d.... Each region of an element holds a Poisson
    number of darts, one on the average at most, given by hashes alone: every set that reaches the
    region sees the same. A dart's number starts with its rank, so the least number is the earliest.
    """
    low, top = 0, int(weight.max(initial=0))
    while low < top:
        wide = max(1, low)
        own = np.flatnonzero(weight > low)
        e, w, o = element[own], weight[own], owner[own]
        reach = limit[o] * wide
        for a, b in ((0.0, 0.25), (0.25, 0.5), (0.5, 1.0)):
            yield from _thrown(e, w, o, reach, np.full(1, a), b - a, low, wide, k)
            go = reach > b
            e, w, o, reach = e[go], w[go], o[go], reach[go]
        # Beyond rank 1/d an element has as many regions as its set reaches; many at a time.
        many = np.ceil(reach - 1).astype(np.int64)
        ends = np.cumsum(many)
        start = 0
        while start < len(e):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + REGIONS, side="right")))
            n = many[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            a = 1.0 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            yield from _thrown(e[i], w[i], o[i], reach[i], a, 1.0, low, wide, k)
            start = stop
        low = low + wide


def _thrown(e: np.ndarray, w: np.ndarray, o: np.ndarray, reach: np.ndarray, a: np.ndarray, area: float, low: int, wide: int, k: int):
    """The darts of one region of each element, which starts at rank ``a`` (one for all, or one each)."""
    h = mixed(e ^ mixed((a * 4).astype(U64) << U64(32) | U64(low)))
    count = np.searchsorted(_poisson(area), (h >> U64(32)).astype(np.float64), side="right")
    has = np.flatnonzero(count)
    j = 0
    while len(has):
        with np.errstate(over="ignore"):
            d = mixed(h[has] + U64(j + 1) * _C3)
        rank = (a if len(a) == 1 else a[has]) + area * _unit(d)
        inside = rank < reach[has]
        if wide > 1:
            inside &= low + wide * _unit(mixed(d ^ _C2)) < w[has]
        d, rank, at = d[inside], rank[inside] / wide, has[inside]
        where = (mixed(d ^ _C1) % U64(k)).astype(np.int64)
        yield o[at] * k + where, rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32) | d >> U64(32)
        j += 1
        has = has[count[has] > j]


def signatures(element: np.ndarray, weight: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash: ``k`` darts for each weighted set; sets lie one after another, ``size`` elements each.

    Two sets agree in a coordinate with the chance of their weighted Jaccard similarity. Ranks
    below about k ln k over the total weight come first; sets that leave a coordinate empty go
    on with twice the ranks. Sets without elements keep the largest number everywhere.
    """
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    total = np.bincount(owner, weight, n)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1)
    out = np.full(n * k, NONE, U64)
    todo = np.flatnonzero(size)
    while len(todo):
        pick = np.zeros(n, bool)
        pick[todo] = True
        m = pick[owner]
        for at, dart in _darts(element[m], weight[m], owner[m], limit, k):
            np.minimum.at(out, at, dart)
        todo = todo[(out.reshape(n, k)[todo] == NONE).any(1)]
        limit[todo] *= 2
    return out.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(signature), bands), U64) + np.arange(bands, dtype=U64)
    part = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mixed(h * _C2 + part[:, :, r])
    return h.astype(np.int64)


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            start = 0
            while start < batch.num_rows:
                sets, words, end, total = [], [], start, 0
                while end < batch.num_rows and total < 300_000:
                    w = word_hashes(texts[end].as_py() or "")
                    words.append(xxhash.xxh3_128_hexdigest(w.tobytes()) if len(w) else None)
                    sets.append(shingles(w))
                    total += len(sets[-1][0])
                    end += 1
                size = np.array([len(s[0]) for s in sets])
                sig = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), size, bands * rows)
                keys = band_keys(sig, bands, rows)
                cols = [batch.column(c).slice(start, end - start) for c in ("doc_id", "key")]
                cols += [pa.array(words, pa.string()), pa.array([int(s[1].sum()) for s in sets], pa.int64())]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "words", "weight", "bands"])
                start = end

    return run


def packed_set(text: str) -> bytes:
    """The weighted set in few bytes: number of elements, 40 bits of each one's hash, and weights above 1."""
    e, c = shingles(word_hashes(text))
    h = e >> U64(24)
    more = np.flatnonzero(c > 1)
    parts = [np.array([len(e)], "<u4"), (h >> U64(8)).astype("<u4"), (h & U64(255)).astype(np.uint8), more.astype("<u4"), c[more].astype("<u4")]
    return b"".join(p.tobytes() for p in parts)


def unpacked_set(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    h = np.frombuffer(raw, "<u4", n, 4).astype(U64) << U64(8) | np.frombuffer(raw, np.uint8, n, 4 + 4 * n)
    rest = np.frombuffer(raw[4 + 5 * n :], "<u4").reshape(2, -1)
    c = np.ones(n, np.int64)
    c[rest[0]] = rest[1]
    return h, c


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [packed_set(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.binary())], ["id", "set"])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted weighted sets: sum of smaller over sum of larger weights."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("left"), batch.column("right"), strict=True)
        score = [weighted_jaccard(unpacked_set(x.as_py()), unpacked_set(y.as_py())) for x, y in sets]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], ["a", "b", "score"])


def _part(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("part")


def _verified(todo: DataFrame, sets: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact similarity is high enough."""
    a = weights.select(F.col("id").alias("a"), F.col("weight").alias("wa"))
    b = weights.select(F.col("id").alias("b"), F.col("weight").alias("wb"))
    # Totals that differ too much can't be similar enough.
    near = todo.join(a, "a").join(b, "b").where(F.least("wa", "wb") >= similarity * F.greatest("wa", "wb") - 1e-9)
    both = near.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b").select("a", "b", "left", "right")
    scored = both.mapInArrow(_compared, "a long, b long, score double")
    return scored.where(F.col("score") >= similarity - 1e-12).select("a", "b").distinct()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, root, raw in zip(*(batch.column(c) for c in ("id", "root", "set")), strict=True):
            h, c = unpacked_set(raw.as_py())
            cols = [pa.array(np.full(len(h), i.as_py())), pa.array(np.full(len(h), root.as_py())), pa.array(h.astype(np.int64)), pa.array(c)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "root", "element", "count"])


def rare_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the members of large buckets, the pairs of different classes that bounds by rare elements leave open.

    A text's elements stand in one order for all: the rarest among these texts first. Of two similar ones take
    the first element in that order that both have, with weights p and q of what stands before it:
    nothing before is common, so the common weight is at most W - p and V - q. It has to be
    s / (1 + s) * (W + V), so the element is among the first 1 - s of either's weight, and V at most
    (W - p) * (1 + s) / s - W. Texts that differ from all others in a fifth of their elements have no such
    element and meet none, whatever the size of their bucket.
    """
    ids = apart.where(F.col("n") > SMALL).select("id", "root").distinct()
    rows = sets.join(ids, "id").select("id", "root", "set").mapInArrow(_elements, "id long, root long, element long, count long")
    rows = stored(rows, "elements")
    often = rows.groupBy("element").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("low"), F.max("root").alias("high"))
    known = rows.join(often.where("often > 1"), "element", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    order = Window.partitionBy("id").orderBy("often", "element")
    before = F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.select("*", before.alias("before"), F.sum("count").over(Window.partitionBy("id")).alias("weight"))
    open_ = known.where((F.col("before") <= (1 - similarity) * F.col("weight") + 1e-6) & (F.col("low") < F.col("high")))
    most = (F.col("weight") - F.col("before")) * ((1 + similarity) / similarity) - F.col("weight") + 1e-6
    open_ = stored(open_.select("element", "id", "root", "weight", most.alias("most")), "prefixes")
    other = open_.select("element", *(F.col(c).alias(f"{c}_b") for c in ("id", "root", "weight", "most")))
    pairs = open_.join(other, "element").where("id < id_b and root <> root_b and weight <= most_b and weight_b <= most")
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the smallest doc_id, of rows repeated
    with it one. All columns stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), row)
    own = own.select("id", F.xxhash64(F.coalesce(F.col("id"), F.lit(-1)), F.col("id").isNull(), F.col("text")).alias("key"), "row")
    kept = near_duplicates(docs, similarity, keyed=True).where("kept").select(F.col("key").alias("kept_key"), F.col("doc_id").alias("kept_id"))
    same = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    once = Window.partitionBy("key", "id").orderBy(F.lit(0))
    return own.join(kept, same, "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, keyed: bool = False) -> DataFrame:
    """Per document: ``doc_id, class_id, class_size, links, kept``.

    Documents are linked when the weighted Jaccard similarity of their five-word shingles (lower
    case, words between white space, weight: how often) is at least ``similarity``; a class is a
    connected component, named by its smallest doc_id, whose row stays. ``links`` counts the links
    of a document's text to other texts that were confirmed.

    Documents with the same words are one text from the start. Texts that share one of 32 bands
    of 4 coordinates meet (a pair at 0.8 misses all with a chance of 5e-8). Each is compared with
    the least ones of its buckets, classes by representatives; then those of a bucket that are still in
    different classes: each with each in small buckets, in large ones all that bounds by rare
    elements leave open (``rare_pairs``, exact). Comparisons are of whole sets. No pair is emitted for two copies of a text.

    A document without words (null, empty) is a class of its own. A null doc_id comes after all
    others, and a class of such rows has a null class_id; rows repeated with their doc_id are one
    class, of which one row stays. Empty table: no rows. Columns besides ``doc_id`` and ``text``
    are ignored.
    """
    with passing(docs.sparkSession):
        return stored(_near_duplicates(docs, similarity, bands, rows, keyed), "near_classes", keep=True)


def _near_duplicates(docs: DataFrame, similarity: float, bands: int, rows: int, keyed: bool) -> DataFrame:
    source = texts_of(docs).withColumn("key", doc_key())
    kinds = "doc_id long, key long, words string, weight long, bands array<long>"
    signed = source.mapInArrow(_signed(bands, rows), kinds).withColumn("row", F.monotonically_increasing_id())
    last = F.lit(2**63 - 1)
    signed = signed.withColumn("order", F.struct(F.coalesce("doc_id", last).alias("d"), F.col("row").alias("r")))
    alone = F.concat(F.lit("-"), F.col("row").cast("string"))
    signed = stored(signed.withColumn("words", F.coalesce("words", alone)).withColumn("part", _part("row", 64)), "signed")
    # One text for each word sequence, by way of parts, as one text may be a third of all rows.
    parts = signed.groupBy("words", "part").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("words").agg(F.min("first").alias("first"), F.sum("n").alias("copies"))
    known = stored(parts.select("words", "part").join(whole, "words"), "texts")
    texts = signed.join(known, ["words", "part"]).where("row = first.r and weight > 0")
    texts = stored(texts.select(F.col("row").alias("id"), "order", "key", "weight", "bands", "copies"), "texts")
    members = bucket_members(texts)
    need = texts.join(members.select("id").distinct(), "id").select("id", "key", F.col("order.d").alias("d"))
    bodies = source.join(need, "key").where(F.coalesce("doc_id", last) == F.col("d"))
    sets = stored(bodies.select("id", "text").mapInArrow(_sets, "id long, set binary"), "sets")
    links, roots = linked(members, lambda pairs: _verified(pairs, sets, texts, similarity), lambda apart: rare_pairs(apart, sets, similarity))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    classes = texts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = classes.groupBy("root").agg(F.min("order").alias("name"), F.sum("copies").alias("class_size"))
    told = classes.select("id", "root").join(named, "root").join(degree, "id", "left").drop("root")
    told = known.join(told, F.col("first.r") == F.col("id"), "left").select("words", "part", "name", "class_size", "links")
    name = F.coalesce("name", "order")
    return signed.select("doc_id", "key", "row", "order", "words", "part").join(told, ["words", "part"]).select(
        "doc_id",
        F.nullif(name["d"], last).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (name["r"] == F.col("row")).alias("kept"),
        *(["key"] if keyed else []),
    )
