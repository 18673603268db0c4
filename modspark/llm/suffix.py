"""Repeated passages across documents: anchors route them to shards, suffix arrays find them there.

1. Of every 50-byte string the least hash among its 20-byte grams is an anchor, so equal strings
   have equal anchors at equal places. The 80 bytes that a 50-byte string with it can reach are its
   context. Anchors that occur in one document only are dropped, and where all contexts of an anchor
   are equal, the least document's covers the others.
2. The other contexts go to shards by their anchor; equal ones are joined to one with the least
   document.
3. Each shard concatenates the spans of its different contexts that another one may hold too, builds
   their suffix array by induced sorting and the common prefixes of neighbours, and so finds equal
   50-byte strings.
4. What is covered goes back to the documents, where spans are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.llm.common import doc_key, shuffle_partitions, texts_of

WIDTH = 50
GRAM = 20
REACH = WIDTH - GRAM  # bytes on either side of an anchor's gram
CONTEXT = WIDTH + REACH
SHARD_BYTES = 160 << 10  # small enough for the caches
LAST = 2**63 - 1  # order of documents without doc_id

_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.array([(i + 1) * 0xD1342543DE82EF95 % 2**64 | 1 for i in range(256)], np.uint64)


# Suffix arrays


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is the sentinel."""
    n = len(s)
    up = np.empty(n, bool)
    up[-1] = True
    up[:-1] = s[:-1] < s[1:]
    differs = np.empty(n, bool)
    differs[-1] = True
    differs[:-1] = s[:-1] != s[1:]
    at = np.flatnonzero(differs)
    return up[at[np.searchsorted(at, np.arange(n))]] if len(at) < n else up


def _leftmost(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _spread(p: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends positions to the buckets of their characters, in the order in which they come."""
    if not len(p):
        return
    order = np.argsort(chars, kind="stable")
    p, chars = p[order], chars[order]
    cut = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    edges = [0, *cut.tolist(), len(p)]
    for a, b in zip(edges, edges[1:], strict=False):
        into[chars[a]].append(p[a:b])


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones, given in order within each first character.

    Bucket after bucket: what a whole bucket induces is placed at once, in the order of the scan.
    """
    none = np.zeros(0, np.int64)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    less: list[list[np.ndarray]] = [[] for _ in range(size)]
    first = s[lms]
    edge = np.searchsorted(first, np.arange(size + 1))
    for c in range(size):
        queue = large[c]
        queue[:] = [np.concatenate(queue)] if queue else []
        k = 0
        while k < len(queue):  # a bucket can induce into itself
            p = queue[k][queue[k] > 0] - 1
            p = p[~small[p]]
            _spread(p, s[p], large)
            k += 1
        p = lms[edge[c] : edge[c + 1]] - 1
        _spread(p, s[p], large)
        large[c] = [np.concatenate(queue)] if len(queue) > 1 else queue
    less[0].append(np.array([len(s) - 1]))
    for c in range(size - 1, -1, -1):
        queue = less[c]
        queue[:] = [np.concatenate(queue)] if queue else []
        k = 0
        while k < len(queue):
            p = queue[k][queue[k] > 0] - 1
            p = p[small[p]]
            _spread(p, s[p], less)
            k += 1
        for part in large[c]:
            p = part[::-1]
            p = p[p > 0] - 1
            p = p[small[p]]
            _spread(p, s[p], less)
    return np.concatenate([none, *(x for c in range(size) for x in (*large[c], *(y[::-1] for y in reversed(less[c]))))])


def _name(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings, in text order; ``order`` has their places sorted."""
    nxt = np.append(lms[1:], len(s) - 1)
    length = np.zeros(len(s), np.int64)
    length[lms] = nxt - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
        live = live[length[a[live]] > k]
    name = np.zeros(len(s), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _by_lists(s: list[int] | np.ndarray, size: int) -> list[int]:
    """Order of the suffixes for the large alphabets of the recursion; ``s`` ends with its one least value.

    Most names stand once, so ranks of twice as many names each round soon differ; only tied ones are sorted again.
    """
    s = np.asarray(s, np.int64)
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.append(True, s[sa[1:]] != s[sa[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of the run
    k = 1
    while not new.all():
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        p = sa[tied]
        key = rank[p] * (n + 1) + rank[np.minimum(p + k, n - 1)]
        o = np.argsort(key, kind="stable")
        p, key = p[o], key[o]
        sa[tied] = p
        new[tied] = np.append(True, key[1:] != key[:-1])
        rank[p] = tied[np.maximum.accumulate(np.where(new[tied], np.arange(len(tied)), 0))]
        k *= 2
    return sa.tolist()


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes of ``s``, whose last value is its one 0; values are below ``size``.

    Classifies suffixes, sorts the leftmost-smaller substrings by inducing from them unsorted,
    names them, recurses on the string of names where names repeat (by doubling where there are many), and
    induces the rest.
    """
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = _classify(s)
    lms = _leftmost(small)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    rough = _induce(s, small, lms[np.argsort(s[lms], kind="stable")], size)
    order = rough[is_lms[rough]]
    names = _name(s, lms, order)
    top = int(names.max()) + 1
    if top < len(lms):
        if top <= 1024:
            order = lms[suffix_array(names.astype(np.uint16), top)]
        else:
            order = lms[np.array(_by_lists(names, top), np.int64)]
    return _induce(s, small, order, size)


def permuted_prefixes(raw: np.ndarray, left: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """At each place of the text: the common prefix with the suffix before it in ``sa``.

    At most ``most``, and within ``left``, the bytes from a place to its context's end. Eight bytes
    are compared at a time, for all places at once.
    """
    n = len(raw)
    wide = np.zeros(n + most + 8, np.uint8)
    wide[:n] = raw
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    bound = np.minimum(np.minimum(left, np.where(before >= 0, left[before], 0)), most)
    live = np.flatnonzero(bound > 0)
    k = 0
    while len(live):
        x = words[live + k] ^ words[before[live] + k]
        whole = x == 0
        part = live[~whole]
        bit = x[~whole]
        bit = bit & (~bit + np.uint64(1))
        out[part] = np.minimum(bound[part], k + np.bitwise_count(bit - np.uint64(1)).astype(np.int64) // 8)
        live = live[whole]
        k += 8
        over = bound[live] <= k
        out[live[over]] = bound[live[over]]
        live = live[~over]
    return out


def least_documents(contexts: np.ndarray, length: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(context, offset)`` of 50-byte strings that a context of a smaller ``order`` has too."""
    n = len(contexts)
    cells = np.arange(contexts.shape[1] + 1)
    inside = cells < length[:, None]
    table = np.full((n, contexts.shape[1] + 1), -1, np.int32)
    table[:, :-1] = contexts
    keep = inside | (cells == length[:, None])
    values = np.where(inside, table + 2, 1)[keep]
    owner = np.broadcast_to(np.arange(n)[:, None], keep.shape)[keep]
    offset = np.broadcast_to(cells, keep.shape)[keep]
    s = np.append(values, 0).astype(np.uint16)
    left = np.append(length[owner] - offset, 0)
    sa = suffix_array(s, 258)
    common = permuted_prefixes(np.append(np.maximum(values - 2, 0), 0).astype(np.uint8), left, sa, WIDTH)
    sa = sa[1:]  # without the sentinel
    sa = sa[left[sa] >= WIDTH]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = common[sa] < WIDTH
    head[0] = True
    at = np.flatnonzero(head)
    least = np.minimum.reduceat(order[owner[sa]], at)
    least = np.repeat(least, np.diff(np.append(at, len(sa))))
    hit = sa[least < order[owner[sa]]]
    return owner[hit], offset[hit]


def shared_spans(contexts: np.ndarray, length: np.ndarray, at: np.ndarray, gram: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: the span of its 50-byte strings around the gram ``at`` that one of another ``order`` may share; ``(0, 0)`` without any.

    Equal strings have their anchor at one place, so strings are held against those that begin as far before the same
    gram. A rolling hash tells which may be equal: what it leaves out is in one context only, or in one document only.
    """
    n = len(contexts)
    cells = np.zeros((CONTEXT, n), np.uint8)  # the gram begins in cell REACH
    for d in np.unique(at).tolist():
        own = np.flatnonzero(at == d)
        cells[REACH - d :, own] = contexts[own, : CONTEXT - REACH + d].T
    low, high = np.full(n, CONTEXT), np.zeros(n, np.int64)
    base, gone = np.uint64(_BASE), np.uint64(pow(_BASE, WIDTH, 2**64))
    with np.errstate(over="ignore"):
        h, salt = np.zeros(n, np.uint64), gram * np.uint64(0x94D049BB133111EB)
        for k in range(WIDTH - 1):
            h = h * base + _LETTERS[cells[k]]
        for k in range(REACH + 1):
            h = h * base + _LETTERS[cells[k + WIDTH - 1]]
            if k:
                h -= _LETTERS[cells[k - 1]] * gone
            start = at - REACH + k
            own = np.flatnonzero((start >= 0) & (start + WIDTH <= length))
            if not len(own):
                continue
            key = h[own] ^ salt[own]
            o = np.argsort(key)
            own, head = own[o], _runs(key[o])
            differ = np.minimum.reduceat(order[own], head) < np.maximum.reduceat(order[own], head)
            own = own[_each(head, len(own), differ)]
            low[own], high[own] = np.minimum(low[own], start[own]), np.maximum(high[own], start[own] + WIDTH)
    return np.where(high > 0, low, 0), high


# Anchors and contexts


def gram_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 20 bytes from each place on, and of the 16, unmixed."""
    with np.errstate(over="ignore"):
        b = [np.uint64(pow(_BASE, k, 2**64)) for k in (1, 2, 4, 8)]
        h1 = _LETTERS[buf]
        h2 = h1[:-1] * b[0] + h1[1:]
        h4 = h2[:-2] * b[1] + h2[2:]
        h = h4[:-4] * b[2] + h4[4:]
        h16 = h[:-8] * b[3] + h[8:]
        h = h16[:-4] * b[2] + h4[16:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h, h16


def _row_hashes(table: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes, whose number is a multiple of 8."""
    with np.errstate(over="ignore"):
        words = np.column_stack([np.ascontiguousarray(table).view(np.uint64), salt.astype(np.uint64)])
        words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        words ^= words >> np.uint64(32)
        weight = np.array([pow(_BASE, k + 3, 2**64) for k in range(words.shape[1])], np.uint64)
        h = words @ weight
        return h ^ (h >> np.uint64(32))


def _context_table(buf: np.ndarray, a: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of the bytes from each ``a`` on, zero beyond ``length``; ``buf`` goes on for one context at least."""
    cells = np.arange(CONTEXT)
    table = buf[a[:, None] + cells]
    table[cells >= length[:, None]] = 0
    return table


def context_hashes(buf: np.ndarray, h16: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the context of each anchor, within its text ``[low, high)``; whole contexts from five hashes of 16 bytes."""
    out = np.zeros(len(at), np.uint64)
    whole = (at - REACH >= low) & (at + GRAM + REACH <= high)
    with np.errstate(over="ignore"):
        step, start, h = np.uint64(pow(_BASE, 16, 2**64)), at[whole] - REACH, np.uint64(0)
        for k in range(0, CONTEXT, 16):
            h = h * step + h16[start + k]
        out[whole] = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    cut = np.flatnonzero(~whole)
    a, b = np.maximum(at[cut] - REACH, low[cut]), np.minimum(at[cut] + GRAM + REACH, high[cut])
    out[cut] = _row_hashes(_context_table(np.append(buf, np.zeros(CONTEXT, np.uint8)), a, b - a), (b - a) * 256 + at[cut] - a)
    return out


def _slide(v: np.ndarray, width: int, best) -> np.ndarray:
    w = 1
    while w * 2 <= width:
        v = best(v[:-w], v[w:])
        w *= 2
    return best(v[: len(v) - (width - w)], v[width - w :]) if w < width else v


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of texts that lie one after another and end at ``ends``; hashes of their grams
    and of their contexts."""
    h, h16 = gram_hashes(buf)
    v = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(v, REACH + 1, np.minimum)  # of the 50-byte string from each place on
    bad = np.zeros(len(buf) + 1, np.int32)
    size = np.diff(ends, prepend=0)
    np.add.at(bad, ends - np.minimum(size, WIDTH - 1), 1)
    np.add.at(bad, ends, -1)
    least[np.cumsum(bad[: len(least)]) > 0] = 0  # strings that reach into the next text
    pad = np.zeros(REACH, np.uint32)
    most = _slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero(v == most[: len(v)])
    which = np.searchsorted(ends, at, side="right")
    return at, h[at], context_hashes(buf, h16, at, (ends - size)[which], ends[which])


def _slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    column, start, got, n = batch.column("text"), 0, [], 0
    for i in range(len(column)):
        t = (column[i].as_py() or "").encode()
        got.append(t)
        n += len(t)
        if n >= limit or len(got) == 60_000:
            yield start, got
            start, got, n = i + 1, [], 0
    if got:
        yield start, got


BLOB = "bucket int, kind int, docs binary, a binary, b binary, c binary, d binary"
TOLD = "ord long, key long, start binary, end binary, whole boolean"


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(a: np.ndarray | bytes) -> bytes:
    """Shuffled bytes, compressed; the size stands first."""
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _steps(values: np.ndarray) -> bytes:
    """Differences of neighbours, which compress better."""
    return _packed(np.diff(values.astype(np.int64), prepend=0).astype("<i4"))


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unpacked(raw), "<i4").astype(np.int64))


def _joint(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") for p in parts[:-1]) + b"".join(parts)


def _parted(raw: bytes) -> tuple[bytes, bytes, bytes]:
    a = 16 + int.from_bytes(raw[:8], "little")
    b = a + int.from_bytes(raw[8:16], "little")
    return raw[16:a], raw[a:b], raw[b:]


def _blob(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bucket", "kind", "docs", "a", "b", "c", "d"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _docs(batch: pa.RecordBatch, start: int, n: int) -> np.ndarray:
    return np.stack([batch.column(c).slice(start, n).to_numpy(zero_copy_only=False) for c in ("ord", "key")], 1).astype(np.int64)


def _by_doc(docs: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """Rows of TOLD: the places of each document together."""
    o = np.argsort(doc, kind="stable")
    doc, start, end = doc[o], start[o].astype("<u4"), end[o].astype("<u4")
    cut = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist(), len(doc)]
    return [(*docs[doc[x]].tolist(), start[x:y].tobytes(), end[x:y].tobytes(), False) for x, y in zip(cut, cut[1:], strict=False) if y > x]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _each(head: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """A value for each run, told to all of its rows."""
    return np.repeat(values, np.diff(np.append(head, n)))


def _span(pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(pos - REACH, 0), np.minimum(pos + GRAM + REACH, size)


def _find_anchors(buckets: int):
    """Blobs of anchors by bucket (kind 0), places of grams in several contexts (1), whole copies (2), spans
    of contexts that a smaller document has too (3).

    What a slice of the input knows is settled in it: equal texts are looked at once, of equal
    contexts the least document's is sent on, and of a gram that stands in different contexts of
    different documents one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch):
                docs, rows = _docs(batch, start, len(texts)), []
                first: dict[bytes, int] = {}
                for i, t in enumerate(texts):
                    k = first.setdefault(t, i)
                    if docs[i, 0] < docs[k, 0]:
                        first[t] = i
                copies = [i for i, t in enumerate(texts) if docs[first[t], 0] < docs[i, 0] and len(t) >= WIDTH]
                if copies:
                    rows.append((int(docs[copies[0], 1]) % buckets, 2, docs[copies].tobytes(), b"", b"", b"", b""))
                used = np.array([i for i, t in enumerate(texts) if docs[first[t], 0] == docs[i, 0] and len(t) >= WIDTH], np.int64)
                if not len(used):
                    if rows:
                        yield _blob(rows)
                    continue
                size = np.array([len(texts[i]) for i in used])
                ends = np.cumsum(size)
                at, h, g = anchors(np.frombuffer(b"".join(texts[i] for i in used), np.uint8), ends)
                which = np.searchsorted(ends, at, side="right")
                pos, doc, n = at - (ends - size)[which], used[which], len(at)
                order = docs[doc, 0]
                o = np.lexsort((g, h))
                h, g, pos, doc, order, size = h[o], g[o], pos[o], doc[o], order[o], size[which][o]
                head = _runs(h, g)
                least = _each(head, n, np.minimum.reduceat(order, head))
                covered = order > least
                a, b = _span(pos, size)
                for x in _by_doc(docs, doc[covered], a[covered], b[covered]):
                    rows.append((x[1] % buckets, 3, np.array(x[:2], np.int64).tobytes(), x[2], x[3], b"", b""))
                h, g, pos, doc, order, size = (c[~covered] for c in (h, g, pos, doc, order, size))
                n, head = len(h), _runs(h)
                mixed = np.minimum.reduceat(order, head) < np.maximum.reduceat(order, head)
                told = _each(head, n, mixed)
                for x in _by_doc(docs, doc[told], pos[told], pos[told]):
                    rows.append((x[1] % buckets, 1, np.array(x[:2], np.int64).tobytes(), x[2], b"", b"", b""))
                ask = ~told
                ask[head] = True
                h, g, pos, doc, told, size = (c[ask] for c in (h, g, pos, doc, told, size))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                o = np.lexsort((pos, doc, bucket))
                h, g, doc, pos, told, bucket, size = (c[o] for c in (h, g, doc, pos, told, bucket, size))
                cut = [*_runs(bucket).tolist(), len(bucket)]
                for x, y in zip(cut, cut[1:], strict=False):
                    ids, one, local = np.unique(doc[x:y], return_index=True, return_inverse=True)
                    code = np.concatenate([(c[x:y] >> np.uint64(8 * (8 - k))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k] for c, k in ((h, 4), (g, 6))], 1)
                    about = _packed(np.diff(docs[ids, 0], prepend=0)), docs[ids, 1].tobytes(), _packed(size[x:y][one].astype("<u4"))
                    rows.append((int(bucket[x]), 0, _joint(*about), code.tobytes(), _steps(local << 1 | told[x:y]), _steps(pos[x:y]), b""))
                yield _blob(rows)

    return run


def _pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["ord", "key", "start", "end", "whole"])


def _shared_anchors(blobs: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: places of grams that stand in several contexts, spans of contexts that a smaller
    document has too, and what was known before."""
    rows: list[tuple] = []
    for kind, docs, a, b in zip(blobs["kind"], blobs["docs"], blobs["a"], blobs["b"], strict=True):
        if kind in (1, 3):
            rows.append((*_pairs(docs)[0].tolist(), a, b, False))
        elif kind == 2:
            rows += [(*x, b"", b"", True) for x in _pairs(docs).tolist()]
    part = blobs[blobs["kind"] == 0]
    if len(part):
        n = [len(x) // 10 for x in part["a"]]
        raw = np.frombuffer(b"".join(part["a"]), np.uint8).reshape(-1, 10)
        code = np.ascontiguousarray(raw[:, :4]).view("<u4").ravel()
        text = np.zeros((len(raw), 8), np.uint8)
        text[:, :6] = raw[:, 4:]
        text = text.view(np.uint64).ravel()
        meta = np.concatenate([_from_steps(x) for x in part["b"]])
        pos = np.concatenate([_from_steps(x) for x in part["c"]])
        about = [_parted(x) for x in part["docs"]]
        keys = [np.frombuffer(k, np.int64) for _, k, _ in about]
        docs = np.stack([np.concatenate([np.cumsum(np.frombuffer(_unpacked(o), np.int64)) for o, _, _ in about]), np.concatenate(keys)], 1)
        size = np.concatenate([np.frombuffer(_unpacked(z), "<u4") for _, _, z in about]).astype(np.int64)
        doc = (meta >> 1) + np.repeat(np.cumsum([0, *map(len, keys)])[:-1], n)
        o = np.lexsort((text, code))
        code, text, doc, pos, told = code[o], text[o], doc[o], pos[o], meta[o] & 1
        order, n = docs[doc, 0], len(o)
        head = _runs(code, text)
        covered = order > _each(head, n, np.minimum.reduceat(order, head))
        head = _runs(code)
        several = np.minimum.reduceat(order, head) < np.maximum.reduceat(order, head)
        contexts = np.minimum.reduceat(text, head) < np.maximum.reduceat(text, head)
        mixed = _each(head, n, several & contexts | (np.maximum.reduceat(told, head) > 0))
        a, b = _span(pos, size[doc])
        covered &= told == 0
        rows += _by_doc(docs, doc[covered], a[covered], b[covered])
        hit = mixed & ~covered & (told == 0)
        rows += [(*x[:3], b"", False) for x in _by_doc(docs, doc[hit], pos[hit], pos[hit])]
    return _told(rows)


def _joined(lists: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(lists), "<u4")).astype(np.int64)


def _groups(table: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Number of each row's content: by hash, then compared; rows that only share a hash stay apart."""
    h = _row_hashes(table, shape)
    o = np.argsort(h, kind="stable")
    differs = np.append(True, (h[o[1:]] != h[o[:-1]]) | (shape[o[1:]] != shape[o[:-1]]) | (table[o[1:]] != table[o[:-1]]).any(1))
    out = np.empty(len(o), np.int64)
    out[o] = np.cumsum(differs) - 1
    return out


def _gram_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the grams that stand ``at`` bytes into contexts."""
    rows = np.zeros((len(table), 24), np.uint8)
    rows[:, :GRAM] = np.take_along_axis(table, at[:, None] + np.arange(GRAM), 1)
    return _row_hashes(rows, np.zeros(len(table), np.int64))


def _cut_contexts(buckets: int):
    """Contexts around places that repeat, by bucket of the anchor (kind 0), and spans already known (1).

    Within a slice a context is sent once, for the least document that has it; in the others all
    of it is covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, wholes = batch.column("starts"), batch.column("whole")
            spans = [batch.column(c) for c in ("span_starts", "span_ends")]
            for at, texts in _slices(batch, 2 << 20):
                docs, rows = _docs(batch, at, len(texts)), []
                doc, pos, bufs = [], [], []
                base = 0
                for i, t in enumerate(texts):
                    if wholes[at + i].as_py():
                        rows += [(int(docs[i, 1]) % buckets, 1, docs[i].tobytes(), np.array([0], "<u4").tobytes(), np.array([len(t)], "<u4").tobytes(), b"", b"")]
                        continue
                    known = [b"".join(c[at + i].as_py() or []) for c in spans]
                    if known[0]:
                        rows.append((int(docs[i, 1]) % buckets, 1, docs[i].tobytes(), *known, b"", b""))
                    p = _joined(starts[at + i].as_py() or [])
                    if len(p):
                        doc.append(np.full(len(p), i))
                        pos.append(p + base)
                        bufs.append(t)
                        base += len(t)
                if not doc:
                    if rows:
                        yield _blob(rows)
                    continue
                doc, pos = np.concatenate(doc), np.concatenate(pos)
                ends = np.cumsum([len(t) for t in bufs])
                which = np.searchsorted(ends, pos, side="right")
                low, high = np.append(0, ends[:-1])[which], ends[which]
                a, b = np.maximum(pos - REACH, low), np.minimum(pos + GRAM + REACH, high)
                buf = np.frombuffer(b"".join(bufs) + b"\0" * CONTEXT, np.uint8)
                length = b - a
                table = _context_table(buf, a, length)
                gram = _gram_of(table, pos - a)
                # What lies before the gram counts too: equal contexts have equal grams at equal places.
                same = _groups(table, length * 256 + (pos - a))
                order = docs[doc, 0]
                least = np.full(same.max() + 1, LAST)
                np.minimum.at(least, same, order)
                covered = order > least[same]
                for x in _by_doc(docs, doc[covered], (a - low)[covered], (b - low)[covered]):
                    rows.append((x[1] % buckets, 1, np.array(x[:2], np.int64).tobytes(), x[2], x[3], b"", b""))
                ask = np.flatnonzero(~covered)
                bucket = (gram[ask] % np.uint64(buckets)).astype(np.int64)
                ask = ask[np.lexsort((pos[ask], bucket))]
                bucket = (gram[ask] % np.uint64(buckets)).astype(np.int64)
                cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(ask)]
                for x, y in zip(cut, cut[1:], strict=False):
                    own = ask[x:y]
                    _, head, local = np.unique(same[own], return_index=True, return_inverse=True)
                    ids, docno = np.unique(doc[own], return_inverse=True)
                    entry = np.stack([np.diff(c.astype(np.int64), prepend=0) for c in (docno, local, (a - low)[own])]).astype("<i4")
                    one = own[head]
                    shape = np.stack([length[one], (pos - a)[one]], 1).astype(np.uint8)
                    rows.append((int(bucket[x]), 0, docs[ids].tobytes(), _packed(table[one]), shape.tobytes(), b"", _packed(entry)))
                yield _blob(rows)

    return run


def _covered(blobs: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the spans that strings of smaller documents cover."""
    rows: list[tuple] = []
    known = blobs[blobs["kind"] == 1]
    for docs, a, b in zip(known["docs"], known["a"], known["b"], strict=True):
        rows.append((*_pairs(docs)[0].tolist(), a, b, False))
    part = blobs[blobs["kind"] == 0]
    if not len(part):
        return _told(rows)
    table = np.frombuffer(b"".join(map(_unpacked, part["a"])), np.uint8).reshape(-1, CONTEXT)
    shape = np.frombuffer(b"".join(part["b"]), np.uint8).reshape(-1, 2).astype(np.int64)
    gram = _gram_of(table, shape[:, 1])
    entries = [np.cumsum(np.frombuffer(_unpacked(x), "<i4").reshape(3, -1).astype(np.int64), 1).T for x in part["d"]]
    entry = np.concatenate(entries)
    docs = np.concatenate([_pairs(x) for x in part["docs"]])
    n = list(map(len, entries))
    doc = entry[:, 0] + np.repeat(np.cumsum([0, *(len(x) // 16 for x in part["docs"])])[:-1], n)
    context = entry[:, 1] + np.repeat(np.cumsum([0, *(len(x) // 2 for x in part["b"])])[:-1], n)
    start = entry[:, 2]
    same = _groups(table, shape[:, 0] * 256 + shape[:, 1])
    _, one = np.unique(same, return_index=True)
    order = docs[doc, 0]
    least = np.full(len(one), LAST)
    np.minimum.at(least, same[context], order)
    covered = order > least[same[context]]
    length = shape[context, 0]
    found = [(doc[covered], start[covered], (start + length)[covered])]
    # Suffix arrays over the different contexts of anchors that have more than one.
    g = np.argsort(gram[one], kind="stable")
    sorted_ = gram[one][g]
    head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    count = np.diff(np.append(head, len(g)))
    g = g[np.repeat(count > 1, count)]
    # Of these the spans that may hold an equal string; a very common phrase with other text around it has none.
    own = one[g]
    low, high = shared_spans(table[own], shape[own, 0], shape[own, 1], gram[own], least[g])
    g, low, high = g[high > 0], low[high > 0], high[high > 0]
    ends = np.append(_runs(gram[one[g]])[1:], len(g))
    x = 0
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while x < len(g):
        y = int(ends[max(np.searchsorted(ends, x + SHARD_BYTES // CONTEXT, side="right") - 1, np.searchsorted(ends, x, side="right"))])
        part, a = table[one[g[x:y]]], low[x:y]
        part = np.take_along_axis(part, np.minimum(a[:, None] + np.arange(CONTEXT), CONTEXT - 1), 1)
        which, offset = least_documents(part, high[x:y] - a, least[g[x:y]])
        hits.append((g[x:y][which], offset + a[which]))
        x = y
    if hits:
        which, offset = (np.concatenate(c) for c in zip(*hits, strict=True))
        # Every document that has the context as its least one gets the strings' places.
        o = np.argsort(which, kind="stable")
        which, offset = which[o], offset[o]
        ask = np.flatnonzero(~covered)
        a, b = np.searchsorted(which, same[context[ask]]), np.searchsorted(which, same[context[ask]], side="right")
        n = b - a
        take = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(start[ask], n) + offset[take]
        found.append((np.repeat(doc[ask], n), at, at + WIDTH))
    doc, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    # Overlapping spans of a document become one.
    o = np.lexsort((a, doc))
    doc, a, b = doc[o], a[o], b[o]
    if len(doc):
        far = np.maximum.accumulate(b + doc * (1 << 33)) - doc * (1 << 33)
        new = np.append(True, (doc[1:] != doc[:-1]) | (a[1:] > far[:-1]))
        at = np.flatnonzero(new)
        doc, a, b = doc[at], a[at], np.maximum.reduceat(b, at)
    return _told(rows + _by_doc(docs, doc, a, b))


def _finish(with_text: bool, rest: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ends, starts, texts = batch.column("ends"), batch.column("starts"), batch.column("text")
            for i in range(batch.num_rows):
                t = (texts[i].as_py() or "").encode()
                a = np.frombuffer(b"".join(starts[i].as_py() or []), "<u4")
                b = np.frombuffer(b"".join(ends[i].as_py() or []), "<u4")
                if len(a):
                    edge = np.zeros(len(t) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, spans = t, 0
                row = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + with_text]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 4 + with_text]
            own = ["ord", "key", *rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *cols], [*own, *names])

    return run


def repeated_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Removes each byte that a 50-byte string covers which also starts in a document with a smaller doc_id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with ``with_text`` also
    ``kept_text`` (bytes of a character that was cut in two are left out). Strings are judged on
    the input, matches stay within documents, overlaps count. Null text counts as empty; texts
    under 50 bytes stay whole. A null doc_id comes after all others, and two of those, as rows
    repeated with their doc_id, don't remove each other's strings. An empty table gives no rows.
    Other columns are ignored.
    """
    source = texts_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), doc_key().alias("key"), "text")
    done = _cut(source, with_text)
    return done.withColumn("doc_id", F.nullif("ord", F.lit(LAST))).select("doc_id", *done.columns[2:])


def cut_passages(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` as ``repeated_passages`` leaves it; other columns as they are, null texts empty."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    own = own.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), doc_key().alias("key"), "text", "row")
    out = _cut(own, True)
    return out.select(*(F.col("kept_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def _cut(source: DataFrame, with_text: bool) -> DataFrame:
    """``source`` has ``ord, key, text``; columns beside these go with the texts, which are shuffled once."""
    buckets = max(48, shuffle_partitions(source.sparkSession))
    rest = tuple(c for c in source.columns if c not in ("ord", "key", "text"))
    blobs = source.select("ord", "key", "text").mapInArrow(_find_anchors(buckets), BLOB)
    places = blobs.groupBy("bucket").applyInPandas(_shared_anchors, TOLD)
    is_span = F.length("end") > 0
    asked = places.groupBy("ord", "key").agg(
        F.collect_list(F.when(~is_span, F.col("start"))).alias("starts"),
        F.collect_list(F.when(is_span, F.col("start"))).alias("span_starts"),
        F.collect_list(F.when(is_span, F.col("end"))).alias("span_ends"),
        F.max("whole").alias("whole"),
    )
    contexts = source.join(asked, ["ord", "key"]).mapInArrow(_cut_contexts(buckets), BLOB)
    spans = contexts.groupBy("bucket").applyInPandas(_covered, TOLD)
    cuts = spans.groupBy("ord", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    kinds = T.StructType([source.schema[c] for c in ("ord", "key", *rest)])
    for c in ("n_bytes", "n_removed", "n_spans"):
        kinds.add(c, "long")
    for c in ("kept_sha256", "kept_text")[: 1 + with_text]:
        kinds.add(c, "string")
    return source.join(cuts, ["ord", "key"], "left").mapInArrow(_finish(with_text, rest), kinds)
