"""A corpus through five operators of ``modspark.llm``, stage after stage.

Each stage takes what its predecessor kept, as a DataFrame with the columns of ``documents``
(``doc_id, text, lang, source, n_chars``), and returns the same columns; the last returns packed
pieces. Between stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.llm.common import stored, table
from modspark.llm.langid import identify, train
from modspark.llm.lines import dedup_lines
from modspark.llm.minhash import keep_one
from modspark.llm.packing import pack_documents
from modspark.llm.queries import CHECKS, QUERIES, tokenizer_file
from modspark.llm.suffix import cut_passages

LEAST_SCORE = 0.2
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null, without a letter, or with a score under 0.2 (a text of
    any of the learned languages stays). ``lang`` becomes what the text was found to be."""
    known = identify(docs, train(docs), docs.columns)
    kept = known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that near-equal a line of an earlier document, or earlier in the same; a document
    that loses all its lines goes."""
    kept = dedup_lines(docs).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return _counted(kept)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return keep_one(docs).select(COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 bytes and more that a document with a smaller doc_id has; a document that
    loses all its text goes."""
    kept = cut_passages(docs).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return _counted(kept)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 1024, added=True)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", passage_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained model nor the hashes; the tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
if ORACLE_SQL:
    CHECKS["pipeline"] = ORACLE_SQL
