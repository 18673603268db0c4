"""Byte-level BPE by whole matrices: every row merges one pair a round."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from modspark.llm.common import texts_of

NONE = np.int32(2**31 - 1)
LONG = 256
CACHE = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """Open-addressing hash table from two token ids to the id of what they merge into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), bool)
            won[one] = True
            won &= free
            self.keys[slot[won]], self.values[slot[won]] = key[won], value[won]
            key, value, slot = key[~won], value[~won], (slot[~won] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (and rank) of the merge, ``NONE`` where there is none or a side is padding (< 0)."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        shape, key = key.shape, np.ascontiguousarray(key).ravel()
        out = np.full(len(key), NONE, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = key[at]
        slot = self._slot(key)
        while len(at):
            seen = self.keys[slot]
            hit = seen == key
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (seen >= 0)
            at, key, slot = at[go], key[go], (slot[go] + 1) & self.mask
        return out.reshape(shape)


class Vocabulary:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        found = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.pairs = Pairs(*(np.array(c, np.int32) for c in zip(*found, strict=True)))
        self.pattern = regex.compile(pattern)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian: itself where it is a token, else merged from its bytes."""
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self._long(self.bytes[np.frombuffer(w, np.uint8)]).astype("<u4").tobytes()
            elif w:
                buckets.setdefault((len(w) - 1).bit_length(), []).append(i)
            else:
                out[i] = b""
        for width, members in buckets.items():
            for k in range(0, len(members), 65536 >> max(0, width - 3)):
                part = members[k : k + (65536 >> max(0, width - 3))]
                for i, ids in zip(part, self._matrix([words[i] for i in part], 1 << width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], -1)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rank = np.concatenate([rank, np.full((n, 1), NONE, np.int32)], 1)
        out: list = [None] * n
        row = np.arange(n)
        while len(row):
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(row)), at]
            over = best == NONE
            if over.any():
                ends = (np.cumsum(size[over]) * 4).tolist()
                flat = ids[over][np.arange(width) < size[over, None]].astype("<u4").tobytes()
                for i, a, b in zip(row[over].tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
                go = ~over
                row, ids, rank, at, best, size = row[go], ids[go], rank[go], at[go], best[go], size[go]
                if not len(row):
                    break
            r = np.arange(len(row))
            # Compaction: what stands right of the merged pair moves left by one.
            take = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            size -= 1
            ids[r, size] = -1
            rank[r, np.maximum(size - 1, 0)] = NONE
            ids[r, at] = best
            last = at >= size - 1
            rank[r, at] = np.where(last, NONE, self.pairs.get(best, ids[r, np.minimum(at + 1, width - 1)]))
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], best[left])
        return out

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long row. All places of the least rank merge in one round, as far as no merge
        on the way makes a pair of a smaller rank; then the order of merges makes no difference."""
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank) and (r := rank.min()) != NONE:
            at = np.flatnonzero(rank == r)
            # In a chain of overlapping places every second one merges.
            head = np.concatenate([[True], np.diff(at) > 1])
            start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            prev = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            prev[1:][np.diff(at) == 2] = r
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            new = np.full(len(at), r, np.int32)
            low = (self.pairs.get(prev, new) < r) | (self.pairs.get(new, after) < r)
            if low.any():
                at = at[: int(low.argmax()) + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids.copy()
            ids[at] = r
            ids = ids[keep]
            rank = self.pairs.get(ids[:-1], ids[1:])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def segments(text: str) -> list[str] | None:
    """Cuts before each single space that stands between two other characters.

    A match of the split pattern never crosses such a place, so the segments can be encoded one
    by one. None where some space stands beside other white space: then the text is one segment.
    """
    parts = text.split(" ")
    if len(parts) > 1:
        parts[1:] = [" " + p for p in parts[1:]]
    return parts


def clean(segment: str) -> bool:
    return segment[-1:].isalpha() and segment[1:2].isalpha() or segment.strip() == segment.removeprefix(" ") != ""


@lru_cache(2)
def word_encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, so its caches last from task to task."""
    return vocabulary_encoder(vocabulary(path, pattern))


class Encoder:
    """Ids of whole texts as little-endian bytes; segments seen before come from a bounded cache.

    ``encode(list of segments) -> list of ids`` does the work for those not seen yet.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = CACHE) -> None:
        self.encode, self.size = encode, size
        self.cache: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        done, got = 0, [segments(t) for t in texts]
        while done < len(texts):
            end, n = done, 0
            while end < len(texts) and (n == 0 or n + len(got[end]) < 200_000):
                n += len(got[end])
                end += 1
            if len(self.cache) > self.size:
                self.cache.clear()
            # Texts encoded whole are kept apart from the segments, and until the chunk's last row is out:
            # they may occur again, and as a segment the same characters can stand where no cut is clean.
            new: dict[str, None] = {}
            whole: dict[str, bytes] = {}
            for i in range(done, end):
                fresh = [s for s in got[i] if s not in self.cache]
                if len(got[i]) == 1 or not all(map(clean, fresh)):
                    got[i] = None
                    whole[texts[i]] = b""
                else:
                    new.update(dict.fromkeys(fresh))
                    self.cache.update(dict.fromkeys(fresh, b""))
            ids = self.encode([*new, *whole])
            self.cache.update(zip(new, ids, strict=False))
            whole = dict(zip(whole, ids[len(new) :], strict=True))
            for i in range(done, end):
                yield whole[texts[i]] if got[i] is None else b"".join(map(self.cache.__getitem__, got[i]))
                got[i] = None
            done = end


def plain(segment: str) -> list[str] | None:
    """The matches of a space with letters, also before one full stop or comma; None for all else."""
    if segment[:1] == " ":
        body = segment[1:]
        if body.isalpha():
            return [segment]
        if segment[-1] in ".,!?;:" and body[:-1].isalpha():
            return [segment[:-1], segment[-1]]
    return None


def by_words(
    split: Callable[[str], list[str]], encode_words: Callable[[list[str]], list[bytes]], size: int = CACHE
) -> Callable[[list[str]], list[bytes]]:
    """Encodes segments word by word; ``split`` cuts those that aren't plain. Words seen before
    come from a bounded cache."""
    known: dict[str, bytes] = {}

    def encode(new: list[str]) -> list[bytes]:
        if len(known) > size:
            known.clear()
        cut = [plain(s) or split(s) for s in new]
        words = list({w for s in cut for w in s if w not in known})
        known.update(zip(words, encode_words(words), strict=True))
        return [known[s[0]] if len(s) == 1 else b"".join([known[w] for w in s]) for s in cut]

    return encode


def vocabulary_encoder(vocab: Vocabulary, size: int = CACHE) -> Encoder:
    return Encoder(by_words(vocab.pattern.findall, lambda words: vocab.encode_words([w.encode() for w in words]), size), size)


def text_slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, null as empty, a few megabytes at a time."""
    column, start, got, n = batch.column("text"), 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        got.append(t)
        n += len(t)
        if n >= limit:
            yield start, got
            start, got, n = i + 1, [], 0
    if got:
        yield start, got


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256``, with ``with_ids`` also ``ids``. Null text counts as empty: no ids, digests
    of the empty string. Nothing is shuffled. Rows come back as they are: repeated rows and null
    doc_ids too. A single match of any length is merged in passes over all its equal pairs.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        encoder, decimal = word_encoder(path, pattern), {i: str(i) for i in vocab.tokens}
        for batch in batches:
            for start, texts in text_slices(batch):
                n, a, b, ids = [], [], [], []
                for raw in encoder.texts(texts):
                    got = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(got))
                    a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, got)).encode()).hexdigest())
                    b.append(hashlib.sha256(vocab.decode(got)).hexdigest())
                    if with_ids:
                        ids.append(got)
                out = [batch.column("doc_id").slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return texts_of(docs).mapInArrow(run, schema)
