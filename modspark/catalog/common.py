"""Registry and shared inputs of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.functions.text import WS_CHARS
from modspark.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents for row-heavy text work."""
    return spread(table(spark, folder, "documents").select(*columns), "doc_id")


# Scores derived from a row id: whole-number arithmetic, the same in every engine.
_COEF = [(7919, 13), (6101, 29), (4801, 31), (3571, 57), (2741, 71), (1993, 97)]


def derived_scores(row_id: str, shift: int = 0) -> list[Column]:
    return [((F.col(row_id) * a + b + shift) % 10001) / 10000.0 for a, b in _COEF]


def derived_sql(row_id: str, shift: int = 0) -> list[str]:
    return [f"((({row_id} * {a} + {b} + {shift}) % 10001) / 10000::DOUBLE)" for a, b in _COEF]


def derived_array(row_id: str, shift: int = 0) -> Column:
    return F.array(*derived_scores(row_id, shift))


# SQL snippets of the text rules.
WS_SQL = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_SQL = r"\pL\pN_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(e: str) -> str:
    return f"trim({e}, {q(WS_CHARS)})"


def tokens_sql(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '[{WS_SQL}]+'), lambda x: x <> '')"


def clean_sql(e: str) -> str:
    t = f"nfc_normalize(coalesce({e}, ''))"
    t = rf"regexp_replace({t}, '[\x{{200b}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{2060}}-\x{{2069}}\x{{feff}}]+', '', 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"lower({strip_sql(t)})"


def md5_sql(seed: int, e: str) -> str:
    return f"md5('{seed}|' || {e})"


def hash_int_sql(seed: int | str, e: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {e}), 1, 7) AS BIGINT)"


SECONDS_SQL = "CAST(floor(epoch(ts)) AS BIGINT)"
LABELS = k.LABELS
