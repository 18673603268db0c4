"""SQL names for the row-level functions.

Each one is a ``CREATE TEMPORARY FUNCTION ... RETURN`` over builtins, so SQL users
get the same JVM-side plan as the DataFrame functions.  Canonical composition is the
one Python function and is registered under its own name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

from modspark import constants as k
from modspark.functions import lang, text
from modspark.lexicon import HALF_POINT, default_lexicon


def _sql(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(ch if ch >= " " else f"\\u{ord(ch):04x}" for ch in escaped) + "'"


def _raw(pattern: str) -> str:
    """Raw SQL literal of a pattern (patterns here hold no quote)."""
    return f"r'{pattern}'"


def _literals(values: Sequence[str]) -> str:
    return "array(" + ", ".join(_sql(v) for v in values) + ")"


def _rounded(values: str, x: str, digits: int) -> str:
    """Array of ``x`` (of each element ``v``) in units of the last digit, by the rule of ``maths.round_exact``."""
    tens, unit, half = 10**digits, 2**46, 2**45
    parts = f"transform({values}, v -> named_struct('ones', floor({x}), 'part', ({x} - floor({x})) * {unit}D))"
    whole = f"transform({parts}, e -> named_struct('ones', e.ones, 'n', floor(e.part), 'rest', e.part - floor(e.part)))"
    tail = f"shiftright(e.n * {tens}L, 46)"
    past = f"cast(e.n * {tens}L - {tail} * {unit}L - {half}L AS DOUBLE) + e.rest * {tens}D"
    units = f"transform({whole}, e -> named_struct('units', e.ones * {tens}L + {tail}, 'past', {past}))"
    return f"transform({units}, e -> e.units + CASE WHEN e.past > 0 OR (e.past = 0 AND e.units % 2 = 1) THEN 1L ELSE 0L END)"


def _chain(start: str, steps: Sequence[tuple[str, str]]) -> str:
    """Nested regular replacements, the first step innermost."""
    for pattern, replacement in steps:
        start = f"regexp_replace({start}, {_raw(pattern)}, {_sql(replacement)})"
    return start


def _leet(t: str) -> str:
    """Symbols that stand for letters; a text without a symbol is not searched for its places."""
    word, ws = text.WORD, text.WS
    for symbol, letter in text.fv.LEET_SYMBOLS:
        sign = re.escape(symbol)
        step = (f"(?:(?<=[{word}])|\\G(?!^))([^{word}{ws}{sign}]*){sign}(?=[^{word}{ws}]*+[{word}])", f"$1{letter}")
        t = _bound(t, "v", f"CASE WHEN contains(v, {_sql(symbol)}) THEN {_chain('v', [step])} ELSE v END")
    return t


def _plain_scrub(t: str) -> str:
    forms, gone = text.plain_forms(text.fv.PLAIN_SCRUB_WORDS), "v"
    for form in forms:
        gone = f"replace({gone}, {_sql(form)}, '')"
    return _single_spaces(_bound(t, "v", f"CASE WHEN {_any_of(forms, 'v')} THEN {gone} ELSE v END"))


def _rare(t: str) -> str:
    return f"{t} rlike {_raw(text.NOT_PLAIN)} AND {t} rlike {_raw(text.RARE_WS)}"


def _single_spaces(t: str) -> str:
    runs = f"CASE WHEN {_rare('w')} THEN {_chain('w', [(text.WS_RUNS, ' ')])} ELSE {_chain('w', [(text.PLAIN_RUNS, ' ')])} END"
    return f"btrim({_bound(t, 'w', runs)}, ' ')"


def _tokens_of(words: Sequence[str], not_ws: str) -> str:
    return f"regexp_extract_all(lower(t), {_raw(lang.whole_tokens(words, not_ws))}, 1)"


def _any_of(parts: Sequence[str], t: str) -> str:
    return f"exists({_literals(text.shortest(parts))}, p -> contains({t}, p))"


def _count(block: str, t: str = "t") -> str:
    return f"length({t}) - length(regexp_replace({t}, {_raw('[' + block + ']+')}, ''))"


def _bound(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _scrub_hit(t: str) -> str:
    """Can any rule match? Letters that only case folding maps to ASCII count as a match."""
    return f"(lower({t}) rlike {_raw(text.any_scrub_word(text.fv.SCRUB_RULES))} OR {t} rlike r'[\u0130\u0131\u017f\u212a]')"


_LABELS = _literals(k.LABELS)
_TOKENS = f"filter(split(lower(t), {_raw('[' + text.WS + ']+')}), x -> x != '')"
_TERMS = "|".join(re.escape(t) for t in sorted(default_lexicon(), key=lambda t: (-len(t), t)))
_BLOCKS = text.fv.SCRIPT_BLOCKS
_OTHER = "CASE WHEN coalesce(fallback, 'en') = 'hi' THEN 'hi-en' ELSE coalesce(fallback, 'en') END"

_DDL = {
    "mod_severity": (
        "score DOUBLE",
        "STRING",
        "CASE WHEN score < 0.30 THEN 'SAFE' WHEN score < 0.55 THEN 'LOW' "
        "WHEN score < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END",
    ),
    "mod_action": (
        "severity STRING",
        "STRING",
        "CASE severity WHEN 'HIGH' THEN 'BLOCKED' WHEN 'MEDIUM' THEN 'FLAGGED' ELSE 'DELIVERED' END",
    ),
    "mod_is_toxic": ("score DOUBLE", "BOOLEAN", "score >= 0.30"),
    "mod_squeeze": (
        "t STRING",
        "STRING",
        "regexp_replace(t, r'([^\\n])\\1{2,}', r'$1$1')",
    ),
    "mod_homoglyphs": (
        "t STRING",
        "STRING",
        f"translate(t, '{text.fv.HOMOGLYPH_FROM}', '{text.fv.HOMOGLYPH_TO}')",
    ),
    "mod_channel_name": (
        "t STRING",
        "STRING",
        f"btrim(regexp_replace(lower(btrim(t, {_sql(text.WS_CHARS)})), '^#', ''), {_sql(text.WS_CHARS)})",
    ),
    "mod_snippet": (
        "t STRING, n INT",
        "STRING",
        "CASE WHEN length(t) <= n THEN t ELSE concat(left(t, n - 3), '...') END",
    ),
    "mod_has_devanagari": (
        "t STRING",
        "BOOLEAN",
        "coalesce(t rlike r'[\\u0900-\\u097F]', false)",
    ),
    "mod_is_indian_language": (
        "code STRING",
        "BOOLEAN",
        "coalesce(code IN (" + ", ".join(f"'{c}'" for c in text.fv.INDIAN_CODES) + "), false)",
    ),
    "mod_mask": (
        "t STRING",
        "STRING",
        "regexp_replace(regexp_replace(regexp_replace(t, "
        "r'(?i)(?:https?://|www\\.)[^\\s<>\\x22\\x27]+', '<URL>'), "
        "r'@(?<![A-Za-z0-9_]@)[A-Za-z0-9_]+', '<USER>'), '[0-9]+', '<NUM>')",
    ),
    "mod_sigmoid": ("x DOUBLE", "DOUBLE", "1.0D / (1.0D + exp(-x))"),
    "mod_softplus": ("x DOUBLE", "DOUBLE", "greatest(x, 0D) + log1p(exp(-abs(x)))"),
    "mod_perplexity": ("loss DOUBLE", "DOUBLE", "CASE WHEN loss < 20 THEN exp(loss) ELSE double('inf') END"),
    "mod_safe_divide": ("a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(try_divide(a, b), 0D)"),
    "mod_strip": ("t STRING", "STRING", f"btrim(t, {_sql(text.WS_CHARS)})"),
    "mod_word_count": (
        "t STRING",
        "INT",
        f"size(filter(split(t, {_raw('[' + text.WS + ']+')}), x -> x != ''))",
    ),
    "mod_clean": (
        "t STRING",
        "STRING",
        f"lower(btrim(regexp_replace(regexp_replace(regexp_replace(mod_nfc(coalesce(t, '')), "
        f"{_raw(text.INVISIBLE_RUNS)}, ''), {_raw('[ \\t]{2,}|\\t')}, ' '), "
        f"{_raw('\\n{3,}')}, '\\n\\n'), {_sql(text.WS_CHARS)}))",
    ),
    "mod_join_separated": (
        "t STRING",
        "STRING",
        f"regexp_replace(t, {_raw(text.LONE_SEP)}, '')",
    ),
    "mod_deleet_digits": (
        "t STRING",
        "STRING",
        f"translate(t, '{text.fv.LEET_DIGITS_FROM}', '{text.fv.LEET_DIGITS_TO}')",
    ),
    "mod_strip_quotes": (
        "t STRING",
        "STRING",
        "CASE WHEN length(t) >= 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN ('\"', '\\'') "
        f"THEN btrim(substring(t, 2, length(t) - 2), {_sql(text.WS_CHARS)}) ELSE t END",
    ),
    "mod_email_key": ("t STRING", "STRING", "lower(t)"),
    "mod_feedback_id": ("id STRING", "STRING", "concat('fb-', substring(id, 1, 8))"),
    "mod_training_prompt": (
        "t STRING",
        "STRING",
        f"concat({_sql(text.fv.TRAINING_PROMPT_HEAD)}, '\\nToxic: ', t, '\\n', {_sql(text.fv.COMPLETION_MARKER)})",
    ),
    "mod_generic_reply": (
        "t STRING",
        "BOOLEAN",
        "t IS NULL OR t = '' OR "
        + " OR ".join(f"contains(lower(t), {_sql(p)})" for p in text.fv.GENERIC_REPLY_PHRASES),
    ),
    "mod_needs_rewrite": ("toxic BOOLEAN, severity STRING", "BOOLEAN", "toxic AND severity IN ('MEDIUM', 'HIGH')"),
    "mod_route": (
        "flagged BOOLEAN, devanagari BOOLEAN",
        "STRING",
        "CASE WHEN NOT flagged THEN 'pass' WHEN devanagari THEN 'devanagari' ELSE 'latin' END",
    ),
    "mod_top_score": ("scores ARRAY<DOUBLE>", "DOUBLE", "array_max(scores)"),
    "mod_context": (
        "turns ARRAY<STRING>, n INT",
        "STRING",
        "CASE WHEN size(turns) > 0 THEN array_join(slice(turns, greatest(1, size(turns) - n + 1), n), ' ') END",
    ),
    "mod_deleet_symbols": ("t STRING", "STRING", _leet("t")),
    "mod_normalize": (
        "t STRING",
        "STRING",
        "mod_deleet_symbols(mod_deleet_digits(mod_join_separated(mod_squeeze(mod_homoglyphs(mod_clean(t))))))",
    ),
    "mod_script_counts": (
        "t STRING",
        "STRUCT<" + ", ".join(f"{name}: INT" for name, _, _ in _BLOCKS) + ", latin: INT>",
        _bound(
            f"coalesce(regexp_replace(t, {_raw('[^' + lang.ANY_INDIAN[1:] + '+')}, ''), '')",
            "v",
            "named_struct(" + ", ".join(f"'{name}', {_count(block, 'v')}" for name, block, _ in _BLOCKS) + f", 'latin', {_count('a-zA-Z')})",
        ),
    ),
    "mod_language_of_counts": (
        "c STRUCT<" + ", ".join(f"{name}: INT" for name, _, _ in _BLOCKS) + ", latin: INT>",
        "STRING",
        "transform(array(array_max(array("
        + ", ".join(f"named_struct('n', c.{name}, 'place', {-i}, 'code', '{code}')" for i, (name, _, code) in enumerate(_BLOCKS))
        + f")).code), x -> CASE WHEN coalesce(try_divide(c.latin, c.latin + {' + '.join('c.' + name for name, _, _ in _BLOCKS)}), 0D) <= {text.fv.LATIN_SHARE_MIXED}D THEN x "
        "WHEN x = 'hi' THEN 'hi-en' ELSE 'indic-en' END)[0]",
    ),
    "mod_romanised_hits": ("t STRING", "INT", "size(array_distinct(CASE WHEN "
        f"{_rare('t')} THEN {_tokens_of(text.fv.ROMANISED_HINDI, '[^' + text.WS + ']')} ELSE {_tokens_of(text.fv.ROMANISED_HINDI, '\\S')} END))",
    ),
    "mod_language": (
        "t STRING, fallback STRING",
        "STRING",
        f"CASE WHEN mod_strip(coalesce(t, '')) = '' THEN 'en' WHEN t rlike {_raw(lang.ANY_INDIAN)} THEN mod_language_of_counts(mod_script_counts(t)) "
        f"WHEN NOT t rlike '[a-zA-Z]' THEN 'en' ELSE "
        + _bound("mod_romanised_hits(t)", "n", f"CASE WHEN n >= 2 OR (n = 1 AND size(array_distinct({_TOKENS})) <= 5) THEN 'hi-en' ELSE {_OTHER} END")
        + " END",
    ),
    "mod_tidy": (
        "t STRING, original STRING",
        "STRING",
        _bound(
            _bound(
                _bound(
                    _single_spaces("t"),
                    "v", f"CASE WHEN contains(v, ' ,') THEN {_chain('v', [(' , *', ', ')])} ELSE v END",
                ),
                "v", f"CASE WHEN startswith(v, ',') THEN {_chain('v', [('^ *, *', '')])} ELSE v END",
            ),
            "v", "CASE WHEN length(v) > 2 THEN concat(upper(left(v, 1)), substring(v, 2)) ELSE original END",
        ),
    ),
    "mod_scrub": (
        "t STRING",
        "STRING",
        f"mod_tidy(CASE WHEN {_scrub_hit('t')} THEN "
        + _chain("t", [(f"(?iu){text.whole_words(words) if whole else f'(?:{words})'}", new) for words, new, whole in text.fv.SCRUB_RULES])
        + " ELSE t END, t)",
    ),
    "mod_plain_scrub": (
        "t STRING",
        "STRING",
        f"transform(array({_plain_scrub('mod_strip(t)')}), v -> CASE WHEN length(v) < 3 THEN {_sql(text.fv.PLAIN_SCRUB_DEFAULT)} ELSE v END)[0]",
    ),
    "mod_lexicon_points": (
        "t STRING",
        "ARRAY<INT>",
        f"aggregate(regexp_extract_all(t, {_raw('(' + text.whole_words(_TERMS) + ')')}, 1), array_repeat(0, {len(k.LABELS)}), (acc, term) -> "
        f"zip_with(acc, element_at(from_json({_sql(json.dumps(default_lexicon()))}, 'map<string,array<int>>'), term), (a, b) -> a + b))",
    ),
    "mod_lexicon_scores": (
        "t STRING",
        "ARRAY<DOUBLE>",
        f"transform({_rounded('mod_lexicon_points(t)', f'(v / (v + {HALF_POINT}))', 4)}, u -> u / 10000D)",
    ),
    "mod_gate": (
        "scores ARRAY<DOUBLE>, g DOUBLE",
        "ARRAY<DOUBLE>",
        f"CASE WHEN g IS NULL THEN scores WHEN g < {k.GATE_LOW}D AND array_max(scores) >= {k.CUT_LOW}D THEN transform(scores, s -> least(s, g * {k.GATE_FACTOR}D)) "
        f"WHEN g >= {k.GATE_HIGH}D AND array_max(scores) < {k.CUT_LOW}D THEN concat(array(greatest(scores[0], g)), slice(scores, 2, {len(k.LABELS) - 1})) ELSE scores END",
    ),
    "mod_tag_triggers": (
        "scores ARRAY<DOUBLE>, cut DOUBLE",
        "ARRAY<STRING>",
        f"array_compact(zip_with(zip_with({_LABELS}, scores, (l, s) -> named_struct('tag', l, 'score', s)), {_rounded('scores', '(v * 100)', 1)}, "
        "(e, u) -> CASE WHEN e.score >= cut THEN concat(upper(e.tag), ' (', u div 10, '.', u % 10, '%)') END))",
    ),
    "mod_top_tag": ("scores ARRAY<DOUBLE>", "STRING", f"element_at({_LABELS}, cast(array_position(scores, array_max(scores)) AS INT))"),
}

# Rows from one value; for use with LATERAL.
_TABLES = {
    "mod_chunks": (
        "t STRING",
        "seq INT, chunk STRING",
        "SELECT pos, col FROM (SELECT posexplode("
        + _bound("split(t, ' ')", "ws", "transform(ws, (w, i) -> CASE WHEN i < size(ws) - 1 THEN concat(w, ' ') ELSE w END)")
        + "))",
    ),
    "mod_batch": ("texts ARRAY<STRING>", "position INT, message STRING", "SELECT pos, col FROM (SELECT posexplode(texts))"),
}


def register(spark: SparkSession) -> list[str]:
    """Register every function for SQL; returns the names."""
    spark.udf.register("mod_nfc", text.compose_udf())
    for name, (args, returns, body) in _DDL.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}"
        )
    for name, (args, columns, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body}")
    return [*_DDL, *_TABLES, "mod_nfc"]
