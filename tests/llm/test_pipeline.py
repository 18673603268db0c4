"""The pipeline on a small corpus, and the registered queries against their SQL."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PARTS = {"en": "th er an in re he on at".split(), "de": "sch ein ung der ich ge ü".split(), "fr": "eau oi ée qu les ai".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents that hold what each stage takes out, and the texts that should be left."""
    rng = random.Random(9)
    rows, left = [], {}

    def add(i, text, lang, want):
        rows.append((i, text, lang, "s", len(text) if text is not None else None))
        if want:
            left[i] = want

    for i in range(60):
        lang = rng.choice(list(PARTS))
        text = "\n".join(prose(rng, lang, 60) for _ in range(3))
        add(i, text, lang, text)
    add(100, "12 34 -- 56", "en", None)  # no letters
    add(101, None, "en", None)
    add(102, "", "en", None)
    fresh = prose(rng, "en", 50)
    line = rows[0][1].split("\n")[1]
    add(103, f"{fresh}\n{line}", rows[0][2], fresh)  # a line of document 0
    base = prose(rng, "de", 300)
    add(104, base, "de", base)
    for k in range(105, 110):  # near copies: one word changed in a single long line
        words = base.split()
        words[20 * (k - 104)] = "anderswo"
        add(k, " ".join(words), "de", None)
    passage, more = prose(rng, "fr", 30), prose(rng, "fr", 200) + "."
    add(110, f"{more} {passage}", "fr", f"{more} {passage}")
    other = prose(rng, "fr", 220) + ";"
    add(111, f"{other} {passage}", "fr", other)  # a passage of document 110 is cut
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows, left


def test_stages(spark, corpus):
    folder, rows, left = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(left)
    for i, text in left.items():
        assert got[i].text.strip() == text, i
        assert got[i].n_chars == len(got[i].text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, r in got.items():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    assert Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.piece) for r in pieces)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = driver.queries()
    assert {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "repeated_passages", "packing"]


@pytest.mark.parametrize("name", sorted(corpus_pipeline.CHECKS))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = driver.queries()[name](spark, FOLDER)
    want = con.sql(driver.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = Counter(repr(tuple(r[c] for c in order)) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == Counter(repr(tuple(r[i] for i in at)) for r in want.fetchall())
