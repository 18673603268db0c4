"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.bpe import text_slices
from modspark.llm.common import stored, texts_of

END = 2
#: How byte-level BPE files split a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_PER_SHARD = 12_000


@lru_cache(2)
def piece_encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file, with the faster merges of tiktoken.

    In a byte-level BPE file a token's number follows from the rank of the merge that makes it, so
    the ranks are the numbers. The file's added tokens are the encoding's special ones. The ids are
    those of the tokenizers library, which takes twice the time (tests compare them).
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that take or need what stands beside them: {odd}")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - {*printable}))}
    made = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t in made or len(t) == 1}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Tokens of every document and an end mark, cut into pieces of ``capacity`` from the end,
    so only the first piece may be shorter. One row per piece; an empty text is one end mark.
    With ``added``, strings of the file's added tokens are these tokens, as the tokenizers library
    has it by default; else they are ordinary text (its ``encode_special_tokens``)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        encode = partial(encoder.encode, allowed_special="all") if added else encoder.encode_ordinary
        for batch in batches:
            for at, texts in text_slices(batch):
                which, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    raw = np.array([*encode(text), END], "<u4").tobytes()
                    n = len(raw) // 4
                    a, k = 0, 0
                    while a < n:
                        b = a + ((n - a) % capacity or capacity) if not k else a + capacity
                        part = raw[4 * a : 4 * b]
                        which.append(at + i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").tolist())
                        a, k = b, k + 1
                doc = batch.column("doc_id").take(pa.array(which, pa.int64()))
                cols = [doc, pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return texts_of(docs).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: each item goes to the fullest bin that takes it.

    Open bins stand in lists by free space; a bit mask of the spaces in use finds the least
    that is large enough.
    """
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    size = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = size[i]
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
            space -= n
        else:
            b, space = len(bins), capacity - n
            bins.append([i])
        if space:
            by_space[space].append(b)
            mask |= 1 << space
    return bins


def swap_search(bins: list[list[int]], size: list[int], capacity: int, passes: int = 8) -> list[list[int]]:
    """Local search among underfull bins; every step raises the sum of squared fills.

    For a bin, fullest first: take a document of an emptier bin as it is (a move), or for one
    shorter document of its own (one for one), or for two of its own (two for one), or give one
    for two: what fills it most. The bin gets fuller and the other, which was emptier, emptier
    still; bins that run empty go. Ends when a pass changes nothing.
    """
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(passes):
        order = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: -fill[b])
        # Documents of emptier bins by length; the emptiest bin's come last and are taken first.
        have: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        mask = 0
        for b in order:
            for i in bins[b]:
                have[size[i]].append((b, i))
                mask |= 1 << size[i]

        def longest(low: int, high: int, under: int, but: int) -> tuple[int, int] | None:
            """A document of a length in (low, high] of a bin other than ``but``, not fuller than ``under``."""
            nonlocal mask
            part = mask & ((1 << (high + 1)) - 1)
            while part >> (low + 1):
                n = part.bit_length() - 1
                while have[n] and have[n][-1][1] not in bins[have[n][-1][0]]:
                    have[n].pop()  # moved away meanwhile
                if not have[n]:
                    mask &= ~(1 << n)
                elif have[n][-1][0] != but and fill[have[n][-1][0]] <= under:
                    return have[n][-1]
                part &= ~(1 << n)
            return None

        changed = False
        for a in order:
            while 0 < fill[a] < capacity:
                gap = capacity - fill[a]
                best: tuple[int, list[int], int, list[int]] | None = None
                own = sorted(bins[a], key=lambda i: size[i])
                outs: list[list[int]] = [[]] + [[i] for i in own]
                outs += [[own[k], own[k + 1]] for k in range(len(own) - 1)]
                for out in outs:
                    n = sum(size[i] for i in out)
                    got = longest(n, min(capacity, n + gap), fill[a], a)
                    if got and (best is None or size[got[1]] - n > best[0]):
                        best = size[got[1]] - n, out, got[0], [got[1]]
                    if len(out) == 1 and (best is None or best[0] < gap):  # one for two
                        for b in order[::-1][:8]:
                            if b == a or fill[b] > fill[a] or len(bins[b]) < 2:
                                continue
                            two = sorted(bins[b], key=lambda i: size[i])
                            for k in range(len(two) - 1):
                                gain = size[two[k]] + size[two[k + 1]] - n
                                if 0 < gain <= gap and (best is None or gain > best[0]):
                                    best = gain, out, b, [two[k], two[k + 1]]
                    if best and best[0] == gap:
                        break
                if best is None:
                    break
                gain, out, b, come = best
                bins[a] = [i for i in bins[a] if i not in out] + come
                bins[b] = [i for i in bins[b] if i not in come] + out
                fill[a] += gain
                fill[b] -= gain
                for i in out:
                    have[size[i]].append((b, i))
                    mask |= 1 << size[i]
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _pack_shard(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], ignore_index=True)
        size = rows["length"].to_numpy()
        bins = best_fit(size, capacity)
        fill = [int(size[b].sum()) for b in bins]
        full = [b for b, n in zip(bins, fill, strict=True) if n == capacity]
        rest = [b for b, n in zip(bins, fill, strict=True) if n < capacity]
        bins = full + swap_search(rest, size.tolist(), capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        count = np.array([len(b) for b in bins], np.int64)
        number = np.repeat(np.arange(len(bins)), count)
        n = size[order]
        before = np.cumsum(n) - n
        first = np.repeat(np.cumsum(count) - count, count)
        out = rows.iloc[order].copy()
        out["bin"], out["offset"] = number, before - before[first]
        out["fill"] = np.bincount(number, n, len(bins)).astype(np.int64)[number]
        return out

    return pack


def pack(pieces_: DataFrame, capacity: int, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity``.

    Pieces are dealt to shards of about ``rows_per_shard``, each packed by itself. The pieces of
    bins that stayed underfull are dealt anew, to as many fewer shards, and packed together,
    until one shard holds them or a round no longer leaves fewer. A shard's size is bounded by
    the parameter, whatever the input.
    """
    todo = stored(pieces_.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    shape = todo.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    n, turn, done = todo.count(), 0, []
    while True:
        shards = max(1, math.ceil(n / rows_per_shard))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(shards)))
        got = dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), f"{shape}, shard long, bin long, offset long, fill long")
        got = stored(got.withColumn("turn", F.lit(turn)), "packed")
        under = got.where(F.col("fill") < capacity)
        left = under.count()
        if shards == 1 or not left or left > 0.95 * n:
            done.append(got)
            break
        done.append(got.where(F.col("fill") == capacity))
        todo, n, turn = under.select("doc_id", "piece", "start", "length", "ids_crc32"), left, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    number = F.shiftleft(F.col("turn").cast("long"), 56) + F.shiftleft("shard", 24) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, added: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens, as few as it finds.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null text
    counts as empty and is one end mark. Only documents longer than ``capacity`` are cut. Repeated
    rows are packed as often as they occur; null doc_ids are kept. An empty table gives no rows.
    Columns besides ``doc_id`` and ``text`` are ignored. ``added`` is that of ``pieces``.
    """
    return pack(pieces(docs, path, capacity, added=added), capacity)
