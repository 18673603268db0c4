"""Exact dedup, BPE and packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from modspark.llm import bpe, exact, packing

SCHEMA = "doc_id long, text string, least_ int, run int, n int"
ODD = [
    (1, "a b\tc", 1, 1, 1),
    (2, "abc", 2, 2, 2),
    (3, " a  b c ", 3, 3, 3),
    (3, " a  b c ", 3, 3, 3),
    (4, None, None, None, None),
    (5, "", 1, 1, 1),
    (6, " \n", 1, 1, 1),
    (None, "abc ", 1, 1, 1),
    (None, None, None, None, None),
    (7, "é x " * 40_000, 1, 1, 1),
    (8, "<|endoftext|>  two  spaces \n\n end ", 0, 0, 0),
    (9, "a" * 3000, 0, 0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_exact_groups(spark, odd):
    rng = random.Random(4)
    more = [(100 + i, rng.choice(["hot text", "hottext ", "x" * (i % 7), f"own {i}"]), 0, 0, 0) for i in range(400)]
    rows = ODD + more
    got = exact.exact_groups(spark.createDataFrame(rows, SCHEMA), rows_per_run=1).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((-len(t or ""), i if i is not None else 1 << 62, i))
    want = defaultdict(list)
    for norm, members in groups.items():
        for m in members:
            want[m[2], hashlib.sha256(norm.encode()).hexdigest()].append((min(members)[2], len(members)))
    for r in got:
        assert (r.keep_id, r.group_size) in want[r.doc_id, r.text_sha256]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns(odd):
    kept = exact.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 6, 7, 8, 9]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(none).count() == 0
    assert bpe.bpe_roundtrip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def real(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_ids_are_those_of_the_library(vocab, real):
    rng = random.Random(7)
    texts = ["", " ", "\n", "a" * 5000, "ab" * 3000, " " * 3000, "x \n y", "it's  's", " a  b", "<|endoftext|> hi"]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(3000)), "🙂é" * 500, "\x1c a\x1d b"]
    texts += ["".join(rng.choice("ab c\n'séß1.!\t  ,") for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    encoder = bpe.vocabulary_encoder(vocab, size=50)
    for text, raw in zip(texts, encoder.texts(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == real.encode_ordinary(text), text[:80]
        assert vocab.decode(ids) == text.encode()


def test_long_rows_merge_like_the_library(vocab, real):
    rng = random.Random(3)
    for letters in ("ab", "the", "aeiounst", "=-", "\n "):
        word = "".join(rng.choice(letters) for _ in range(2000))
        for match in vocab.pattern.findall(word):
            (ids,) = vocab.encode_words([match.encode()])
            assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(match)


def test_roundtrip_query(odd, real):
    got = bpe.bpe_roundtrip(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    want = []
    for i, t, *_ in ODD:
        ids = real.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_packing_ids_are_those_of_the_library():
    rng = random.Random(8)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = ["".join(rng.choice("ab c\n'séß1.!\t  ,中ªʰ") for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    texts += [" one two, three. <|endoftext|> <|endoftext|>x", "don't  stop", " a" * 7000, " ".join("w" + "o" * i for i in range(300))]
    own = packing.piece_encoder(P.path("byte_bpe_50k.json"))
    for text in texts:
        assert own.encode_ordinary(text) == tok.encode(text, add_special_tokens=False).ids, text


def check_packed(rows, docs, capacity):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = defaultdict(int)
    for i, text, *_ in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        a, k = 0, 0
        while a < len(ids):
            b = a + (((len(ids) - a) % capacity or capacity) if k == 0 else capacity)
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            a, k = b, k + 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing_keeps_every_token(odd):
    check_packed(packing.pack_documents(odd, P.path("byte_bpe_50k.json"), 1024).collect(), ODD, 1024)


def test_packing_over_many_shards_is_near_the_bound(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 90)))) for i in range(3000)]
    pieces = packing.pieces(spark.createDataFrame(docs, "doc_id long, text string"), P.path("byte_bpe_50k.json"), 64)
    rows = packing.pack(pieces, 64, rows_per_shard=300).collect()
    n, tokens = check_packed(rows, docs, 64)
    assert n <= 1.01 * -(-tokens // 64) + 1


def test_swaps_raise_the_squared_fill_and_empty_bins():
    rng = random.Random(6)
    for _ in range(200):
        size = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))]
        order = list(range(len(size)))
        rng.shuffle(order)
        bins, fill = [], []
        for i in order:  # next fit: leaves much to do
            if not bins or fill[-1] + size[i] > 100:
                bins.append([]), fill.append(0)
            bins[-1].append(i)
            fill[-1] += size[i]
        out = packing.swap_search([list(b) for b in bins], size, 100)
        sums = [sum(size[i] for i in b) for b in out]
        assert sorted(i for b in out for i in b) == sorted(order)
        assert all(0 < s <= 100 for s in sums) and len(out) <= len(bins)
        assert sum(s * s for s in sums) >= sum(s * s for s in fill)
