"""Strings of added tokens, as an unmodified Tokenizer has them."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from modspark.llm import packing, queries

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["<|endoftext|> hi", "a<|endoftext|><|endoftext|>b", "x  <|endoftext|>  y\n", "<|endoftext", "<|endoftext|>", "two  words", "<|endoftext|>" + " long" * 3000 + "<|endoftext|>"]


def test_ids_are_the_library_s_by_default():
    tok, own = Tokenizer.from_file(PATH), packing.piece_encoder(PATH)
    for text in TEXTS:
        assert own.encode(text, allowed_special="all") == tok.encode(text, add_special_tokens=False).ids
    assert own.encode(TEXTS[0], allowed_special="all") == [50256, 23105]


def test_the_query_s_ids_are_the_library_s_by_default(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    have = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in queries.QUERIES["op7_pack_sequences"](spark, str(tmp_path)).collect())
    want = []
    for i, text in enumerate(TEXTS):
        ids = [*tok.encode(text, add_special_tokens=False).ids, packing.END]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert have == want
