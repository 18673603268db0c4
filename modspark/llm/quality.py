"""Document quality by histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.llm.common import texts_of
from modspark.llm.minhash import word_hashes

SAMPLE = 20_000
THRESHOLD = 0.3

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        (_BYTES == 32) | (_BYTES == 9),
        _BYTES == 10,
        np.isin(_BYTES, [44, 46, 59, 58]),
        np.isin(_BYTES, [33, 63]),
        np.isin(_BYTES, [34, 39, 40, 41, 45]),
        np.isin(_BYTES, [60, 62, 123, 125, 91, 93, 124, 92]),
        np.isin(_BYTES, [35, 36, 37, 38, 42, 43, 47, 61, 64, 94, 95, 96, 126]),
        (_BYTES < 32) & ~np.isin(_BYTES, [9, 10]),
        _BYTES >= 128,
    ],
    1,
).astype(np.float64)
N_FEATURES = _CLASSES.shape[1] + 14


def statistics(text: str) -> np.ndarray:
    """Shares of kinds of bytes, and how words and lines repeat, over the whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(raw, minlength=256) @ _CLASSES / n
    words = word_hashes(text)
    m = max(1, len(words))
    _, count = np.unique(words, return_counts=True)
    count.sort()
    top = count[::-1]
    p = count / m
    lines = text.split("\n")
    length = np.array([len(x) for x in lines], np.float64)
    both = (words[:-1] ^ (words[1:] << np.uint64(1))) if len(words) > 1 else words[:0]
    more = [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / m,
        len(count) / m,
        (words[1:] == words[:-1]).sum() / m,
        top[:1].sum() / m,
        top[:5].sum() / m,
        -(p * np.log(np.maximum(p, 1e-12))).sum(),
        len(np.unique(both)) / max(1, len(both)),
        len(lines),
        len(set(lines)) / len(lines),
        length.mean(),
        length.std(),
        float((raw[1:] == raw[:-1]).sum()) / n,
    ]
    return np.append(kinds, more)


@dataclass
class Trees:
    """All trees in flat arrays: rows go down them together, one level at a time."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # the right child stands next to it; a leaf points to itself
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            node = np.where(f < 0, node, self.left[node] + (x[rows, np.maximum(f, 0)] > self.cut[node]))
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 10, ridge: float = 2.0) -> Trees:
    """Boosting with the logistic loss. Values are put in at most ``bins`` bins once; a split is
    chosen from histograms of gradients, the smaller child's counted and the sibling's subtracted."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, k), int)
    flat = code + np.arange(k) * bins
    share = min(max(float(y.mean()) if n else 1.0, 1e-4), 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    out: dict[str, list] = {"feature": [], "cut": [], "left": [], "value": []}
    roots, margin = [], np.full(n, base)

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = flat[rows].ravel()
        return np.stack([np.bincount(at, np.repeat(v[rows], k), k * bins).reshape(k, bins) for v in (g, h, np.ones(n))])

    def add() -> int:
        for name, empty in (("feature", -1), ("cut", 0.0), ("left", 0), ("value", 0.0)):
            out[name].append(empty)
        return len(out["feature"]) - 1

    if n == 0 or y.min() == y.max():
        trees = 0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = add()
        roots.append(root)
        todo = [(root, np.arange(n), histogram(np.arange(n), g, h), 0)]
        while todo:
            node, rows, hist, level = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            left = hist.cumsum(2)
            gl, hl, nl = left
            gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            best = int(gain.argmax())
            j, b = divmod(best, bins)
            if level == depth or gain.ravel()[best] < 1e-3 or b >= len(cuts[j]):
                out["value"][node] = -rate * sg / (sh + ridge)
                margin[rows] += out["value"][node]
                continue
            low = code[rows, j] <= b
            parts = [rows[low], rows[~low]]
            small = int(len(parts[1]) < len(parts[0]))
            counted = histogram(parts[small], g, h)
            hists = [counted, hist - counted] if small == 0 else [hist - counted, counted]
            a, c = add(), add()
            out["feature"][node], out["cut"][node], out["left"][node] = j, float(cuts[j][b]), a
            todo += [(a, parts[0], hists[0], level + 1), (c, parts[1], hists[1], level + 1)]
    return Trees(np.array(out["feature"], np.int64), np.array(out["cut"]), np.array(out["left"], np.int64), np.array(out["value"]), np.array(roots, np.int64), depth, base)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for ``quality`` (0 or 1; other values and nulls are left out) from at most ``sample`` labels
    of rows that aren't held out, the first by a hash of doc_id. Only their statistics come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "quality").limit(sample)
    rows = texts_of(docs).join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or "").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").limit(2 * sample).collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    x = np.stack([np.frombuffer(r["x"]) for r in got]) if got else np.zeros((0, N_FEATURES))
    return fit(x, np.array([r["quality"] for r in got], np.float64))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id`` and ``score``; nothing is shuffled, whole texts are read, a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([statistics(t.as_py() or "") for t in batch.column("text")]) if batch.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x), pa.float64())], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted`` (1 from ``threshold`` on).

    Without usable labels, or with labels of one kind, all documents get the same score: the share
    of label 1 (1 where there are none). Repeated rows and null doc_ids come back as they are
    (``held_out`` false for null), a doc_id labelled twice counts twice. Empty tables give no rows.
    Other columns are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
