"""Text functions, ``Column -> Column``.

Java's ``\\w``, ``\\s`` and ``\\b`` are narrower or wider than the rules here need,
so word and space classes are always spelled out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from modspark import fixed_values as fv

# Unicode white space as text rules count it (information separators included).
WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = "\\p{L}\\p{N}_"
# Looked for behind a short test, by which most characters are decided.
RARE_WS = "(?=[^ -~\\u0300-\\u1679])[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NOT_PLAIN = "[^\\t-\\r\\x20-\\x7e]"  # a short class that every rare white space is in
WS_RUNS = f"[{WS}]{{2,}}|[{WS}&&[^ ]]"  # all but single plain spaces
PLAIN_RUNS = "\\s{2,}|[\\t-\\r]"  # the same for a text without rare white space
_SEP = f"[.\\-_{WS}]"
LONE_SEP = f"(?<=[a-z])(?![a-z]){_SEP}(?=[a-z]{_SEP}[a-z])"
INVISIBLE_RUNS = f"(?=[\\u0080-\\x{{10ffff}}])[{fv.INVISIBLE}]+"

# Superset of the characters canonical composition can change or reorder.  A text
# without any of them is already composed and never leaves the JVM.
MAY_RECOMPOSE = (
    "[\\p{M}\\u0300-\\u036f\\u0374\\u037e\\u0387\\u0860-\\u0dff\\u0f00-\\u109f\\u1100-\\u11ff\\u1700-\\u173f"
    "\\u1ab0-\\u1b7f\\u1dc0-\\u1dff\\u1f00-\\u1fff\\u2000\\u2001\\u2126\\u212a\\u212b\\u2329\\u232a\\u2adc"
    "\\uf900-\\ufaff\\ufb1d-\\ufb4f\\x{105c0}-\\x{105ff}\\x{10d00}-\\x{11fff}\\x{16100}-\\x{16fff}"
    "\\x{1d15e}-\\x{1d1ff}\\x{1e000}-\\x{1e9ff}\\x{2f800}-\\x{2fa1f}]"
)


def compose_udf():
    """Arrow UDF for canonical composition.  Nested, so it reaches executors by value."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(compose, StringType())


def nfc(c: Column) -> Column:
    """Canonical composition.  Spark has no builtin, so Arrow carries only the
    texts that may change; all other rows travel as nulls and keep their value."""
    may = c.rlike("[^\\x{0}-\\x{2ff}]") & c.rlike(MAY_RECOMPOSE)  # cheap range test first
    return F.coalesce(compose_udf()(F.when(may, c)), c)


def bind(c: Column, use) -> Column:
    """``use`` applied to ``c`` evaluated once, for expressions that read it several times."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def tokens(c: Column) -> Column:
    """Non-empty white-space separated tokens."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda t: t != "")


def has_rare_ws(c: Column) -> Column:
    return c.rlike(NOT_PLAIN) & c.rlike(RARE_WS)


def single_spaces(c: Column) -> Column:
    """Runs of white space as one space each, none at the ends."""
    return F.btrim(F.when(has_rare_ws(c), F.regexp_replace(c, WS_RUNS, " ")).otherwise(F.regexp_replace(c, PLAIN_RUNS, " ")), F.lit(" "))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def clean_text(c: Column, preserve_case: bool = False, compose: bool = True) -> Column:
    t = F.coalesce(c, F.lit(""))
    t = nfc(t) if compose else t
    t = F.regexp_replace(t, INVISIBLE_RUNS, "")
    t = F.regexp_replace(t, "[ \\t]{2,}|\\t", " ")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    t = strip(t)
    return t if preserve_case else F.lower(t)


def map_homoglyphs(c: Column) -> Column:
    return F.translate(c, fv.HOMOGLYPH_FROM, fv.HOMOGLYPH_TO)


def squeeze_repeats(c: Column) -> Column:
    return F.regexp_replace(c, "([^\\n])\\1{2,}", "$1$1")


def join_separated(c: Column, mode: str = "reference") -> Column:
    """Remove separators put between single letters.

    ``reference`` drops a separator when letter, separator, letter follow the one
    letter before it, so the last separator of a run stays.  ``full`` joins whole
    runs of three or more single letters and leaves ordinary words alone.
    """
    if mode == "reference":
        return F.regexp_replace(c, LONE_SEP, "")
    if mode != "full":
        raise ValueError(f"unknown mode {mode!r}")
    lone_before = "(?<=(?<![a-z])[a-z])"
    lone_after = "[a-z](?![a-z])"
    third_before = f"(?<=(?<![a-z])[a-z]{_SEP}[a-z])"
    return F.regexp_replace(
        c,
        f"{lone_before}(?:{third_before}{_SEP}(?={lone_after})|{_SEP}(?=[a-z]{_SEP}{lone_after}))",
        "",
    )


def _replace_if_present(c: Column, part: str, pattern: str, replacement: str) -> Column:
    return bind(
        c,
        lambda v: F.when(v.contains(part), F.regexp_replace(v, pattern, replacement)).otherwise(v),
    )


def deleet(c: Column, leet_numbers: bool = True) -> Column:
    """Digits become letters everywhere; ``@ $ !`` only between the first and the
    last word character of a non-space run.

    Each symbol pass walks on from a word character or from the previous match
    (``\\G``) and looks ahead to the next word character of the run, so no bound on
    the run length is needed.
    """
    if leet_numbers:
        t = F.translate(c, fv.LEET_DIGITS_FROM, fv.LEET_DIGITS_TO)
    else:
        t = F.array_join(
            F.transform(
                F.regexp_extract_all(c, F.lit(f"([{WS}]+|[^{WS}]+)"), F.lit(1)),
                lambda tok: F.when(tok.rlike("^[0-9]+$"), tok).otherwise(
                    F.translate(tok, fv.LEET_DIGITS_FROM, fv.LEET_DIGITS_TO)
                ),
            ),
            "",
        )
    for symbol, letter in fv.LEET_SYMBOLS:
        s = re.escape(symbol)
        pattern = f"(?:(?<=[{WORD}])|\\G(?!^))([^{WORD}{WS}{s}]*){s}(?=[^{WORD}{WS}]*+[{WORD}])"
        t = _replace_if_present(t, symbol, pattern, f"$1{letter}")
    return t


def normalize_for_toxicity(
    c: Column, mode: str = "reference", leet_numbers: bool = True, compose: bool = True
) -> Column:
    t = clean_text(c, compose=compose)
    t = map_homoglyphs(t)
    t = squeeze_repeats(t)
    t = join_separated(t, mode)
    return deleet(t, leet_numbers)


def whole_words(alternatives: str) -> str:
    return f"(?<![{WORD}])(?:{alternatives})(?![{WORD}])"


def scrub_rewrite(c: Column, rules: Sequence[tuple[str, str, bool]] | None = None) -> Column:
    """Ordered case-insensitive replacements that keep the rest of the message."""
    rules = fv.SCRUB_RULES if rules is None else rules
    chained = c
    for words, replacement, whole in rules:
        pattern = whole_words(words) if whole else f"(?:{words})"
        chained = F.regexp_replace(chained, f"(?iu){pattern}", replacement)
    # A text that no rule matches at first is left alone by the chain.  Letters that only
    # case folding maps to ASCII go to the chain as well.
    hit = F.lower(c).rlike(any_scrub_word(rules))
    folded = c.rlike("[\\u0130\\u0131\\u017f\\u212a]")
    return bind(F.when(hit | folded, chained).otherwise(c), lambda t: _tidy(t, c))


def any_scrub_word(rules: Sequence[tuple[str, str, bool]]) -> str:
    """Pattern of any word of the rules, lower case; words that stand in words are tried behind a test of their first letters."""
    bare, whole = ([w for words, _, k in rules for w in words.lower().split("|") if k == kind] for kind in (False, True))
    first = sorted(w[0] for w in bare if w)
    found = ([whole_words("|".join(whole))] if whole else []) + ([f"(?=[{re.escape(first[0])}-{re.escape(first[-1])}])(?:{'|'.join(bare)})"] if first else [])
    return "|".join(found)


def shortest(parts: Sequence[str]) -> list[str]:
    """The parts that hold no other one: a text contains one of these if it contains any."""
    return [p for p in dict.fromkeys(parts) if not any(o in p for o in parts if o != p)]


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    return F.exists(literal_words(parts), lambda p: c.contains(p))


def literal_words(words: Sequence[str]) -> Column:
    """Constant string array (folded at planning; one expression for any length)."""
    return F.split(F.lit("\u0001".join(words)), "\u0001")


def _tidy(t: Column, original: Column) -> Column:
    t = single_spaces(t)
    t = _replace_if_present(t, " ,", " , *", ", ")
    t = bind(t, lambda v: F.when(v.startswith(","), F.regexp_replace(v, "^ *, *", "")).otherwise(v))
    return bind(
        t,
        lambda v: F.when(
            F.length(v) > 2, F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 2147483647))
        ).otherwise(original),
    )


def simple_scrub(c: Column, words: Sequence[str] | None = None, default: str | None = None) -> Column:
    """Plain removal of each word in lower, Capitalised and UPPER form, in list order."""
    forms = plain_forms(fv.PLAIN_SCRUB_WORDS if words is None else words)

    def without(t: Column) -> Column:
        gone = t
        for form in forms:
            gone = F.replace(gone, F.lit(form), F.lit(""))
        return F.when(contains_any(t, shortest(forms)), gone).otherwise(t)

    t = bind(strip(c), without) if forms else strip(c)
    t = bind(t, single_spaces)
    return bind(t, lambda v: F.when(F.length(v) < 3, F.lit(default or fv.PLAIN_SCRUB_DEFAULT)).otherwise(v))


def plain_forms(words: Sequence[str]) -> list[str]:
    return [form for w in words for form in (w, w.capitalize(), w.upper())]


def is_generic_reply(c: Column, phrases: Sequence[str] | None = None) -> Column:
    phrases = fv.GENERIC_REPLY_PHRASES if phrases is None else phrases
    return c.isNull() | (c == "") | bind(F.lower(c), lambda low: contains_any(low, [p.lower() for p in phrases]))


def strip_quotes(c: Column) -> Column:
    """Remove one pair of equal quotes around the text, then white space."""
    double = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    single = (F.length(c) >= 2) & c.startswith("'") & c.endswith("'")
    return F.when(double | single, strip(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


REWRITE_TEMPLATE = (
    "Rewrite the chat message below without abuse and keep what the sender means.\n"
    'Message: "{text}"\n'
    "Flagged: {flagged}\n"
    "Language: {language}\n"
    "{context}"
    "Reply with the rewritten message only, in the same language."
)


def fill_template(template: str | Column, slots: Mapping[str, Column]) -> Column:
    """Replace every ``{name}`` slot by its column."""
    t = F.lit(template) if isinstance(template, str) else template
    for name, value in slots.items():
        t = F.replace(t, F.lit("{" + name + "}"), value)
    return t


def numbered_turns(turns: Column, keep: int = 4) -> Column:
    """``  [1] first`` lines of the last ``keep`` turns."""
    last = last_n(turns, keep)
    lines = F.transform(last, lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), x))
    return F.array_join(lines, "\n")


def last_n(a: Column, n: int) -> Column:
    """Last ``n`` elements, fewer for shorter arrays."""
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def rewrite_prompt(
    text: Column, language: Column, flagged: Column, turns: Column, template: str = REWRITE_TEMPLATE
) -> Column:
    context = F.when(
        F.size(turns) > 0, F.concat(F.lit("Earlier turns:\n"), numbered_turns(turns), F.lit("\n"))
    ).otherwise("")
    # The message goes in last: slots inside user text are not filled again.
    return fill_template(
        template,
        {
            "flagged": F.when(flagged == "", "Unknown").otherwise(flagged),
            "language": language_name(language),
            "context": context,
            "text": text,
        },
    )


def training_prompt(text: Column) -> Column:
    return F.concat(
        F.lit(fv.TRAINING_PROMPT_HEAD + "\nToxic: "), text, F.lit("\n" + fv.COMPLETION_MARKER)
    )


def clean_completion(
    c: Column, prompt: Column | None = None, marker: str = fv.COMPLETION_MARKER
) -> Column:
    """First line after the last marker; the default for an empty completion."""
    tail = F.split_part(strip(F.substring_index(c, marker, -1)), F.lit("\n"), F.lit(1))
    without = strip(F.replace(c, prompt, F.lit(""))) if prompt is not None else strip(c)
    return F.when(
        c.contains(marker), F.when(tail == "", fv.EMPTY_COMPLETION).otherwise(tail)
    ).otherwise(without)


def channel_name(c: Column, strip_again: bool = True) -> Column:
    t = F.regexp_replace(F.lower(strip(c)), "^#", "")
    return strip(t) if strip_again else t


def email_key(c: Column) -> Column:
    return F.lower(c)


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def word_chunks(c: Column) -> Column:
    """Words split at single spaces, every one but the last with its space."""
    return bind(
        F.split(c, " "),
        lambda words: F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.concat(w, F.lit(" "))).otherwise(w)),
    )


def mask_text(c: Column) -> Column:
    """URLs, then mentions, then numbers."""
    t = F.regexp_replace(c, "(?i)(?:https?://|www\\.)[^\\s<>\"']+", "<URL>")
    t = F.regexp_replace(t, "@(?<![A-Za-z0-9_]@)[A-Za-z0-9_]+", "<USER>")
    return F.regexp_replace(t, "[0-9]+", "<NUM>")


def literal_map(pairs: Mapping) -> Column:
    """A small fixed dictionary as a map constant (folded at planning)."""
    if all(isinstance(x, str) for kv in pairs.items() for x in kv):
        return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def lookup(c: Column, pairs: Mapping, default: Column | str | None = None) -> Column:
    found = F.try_element_at(literal_map(pairs), c)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def language_name(code: Column) -> Column:
    return lookup(code, fv.LANGUAGE_NAMES, code)


def reply_template(code: Column) -> Column:
    return lookup(code, fv.REPLY_TEMPLATES, fv.REPLY_TEMPLATES["en"])
