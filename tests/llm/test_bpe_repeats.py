"""Repeated texts that are encoded whole, and what they leave for later texts."""

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from modspark.llm import bpe

WHOLE = ["a" * 5000, "中文" * 2500, "many words and a newline " * 30 + "\n", "two  spaces " * 30, "short\n"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("texts", [[t, t, "other words", t] for t in WHOLE] + [[" ", "a   x", " ", "\n", "a \n  x"], ["", "", "a", "a"]])
def test_repeated_rows(vocab, texts):
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    encoder = bpe.vocabulary_encoder(vocab)
    for _ in range(2):
        got = [np.frombuffer(raw, "<u4").tolist() for raw in encoder.texts(texts)]
        assert got == [real.encode_ordinary(t) for t in texts]


def test_repeated_rows_in_the_query(spark):
    rows = [(i, t) for i, t in enumerate(WHOLE * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = bpe.bpe_roundtrip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows) and len({(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}) == len(WHOLE)
