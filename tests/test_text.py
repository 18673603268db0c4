import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from modspark.functions import lang as L
from modspark.functions import registry
from modspark.functions import text as T

NORMALIZED = [
    ("", ""),
    ("Hello   World", "hello world"),
    ("x​y", "xy"),
    ("p\n\n\n\nq", "p\n\nq"),
    ("cooool", "cool"),
    ("!!!wow", "!!wow"),
    ("wow!!", "wow!!"),
    ("a.b.c.d", "abc.d"),
    ("a b c", "ab c"),
    ("was a good day", "wasa good day"),
    ("h4te", "hate"),
    ("h!t", "hit"),
    ("a$$", "a$$"),
    ("2024", "2o2a"),
    ("AСE", "ace"),
    ("В", "в"),
    ("a#@#@b !@x$y!", "a#a#ab !@xsy!"),
    ("été", "été"),
]

LANGUAGE = [
    ("  ", "en"),
    ("12345", "en"),
    ("नमस्ते", "hi"),
    ("नमस्ते sir", "hi-en"),
    ("नमस्ते दोस्त a", "hi"),
    ("আমি ok", "indic-en"),
    ("kya hai", "hi-en"),
    ("KYA", "hi-en"),
    ("main road closed", "hi-en"),
    ("main road was closed for repairs today", "fallback"),
    ("kya, hai!", "fallback"),
    ("kya hai a b c d e f", "hi-en"),
]


def run(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_normalize_goldens(spark):
    got = run(spark, [a for a, _ in NORMALIZED], T.normalize_for_toxicity(F.col("t")))
    assert [g[0] for g in got] == [b for _, b in NORMALIZED]


def test_clean_text_is_idempotent_and_null_safe(spark):
    texts = ["  A\tb  C ", None, "x​‌ y", " é é ", "a\n\n\n\n\nb \t \n"]
    once = [r[0] for r in run(spark, texts, T.clean_text(F.col("t")))]
    twice = [r[0] for r in run(spark, once, T.clean_text(F.col("t")))]
    assert once == twice and once[1] == ""


def test_options(spark):
    assert run(spark, ["f.u.n in a b c d"], T.join_separated(F.col("t"), "full")) == [("fun in abcd",)]
    assert run(spark, ["was a good day"], T.join_separated(F.col("t"), "full")) == [("was a good day",)]
    assert run(spark, ["call 2024 h4te"], T.deleet(F.col("t"), False)) == [("call 2024 hate",)]
    with pytest.raises(ValueError):
        T.join_separated(F.col("t"), "other")


def test_composition_prefilter_covers_all_characters(spark):
    """No character outside the prefilter class is changed by composition or can
    compose with the one before it."""
    suspects = set()
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if unicodedata.normalize("NFC", ch) != ch or unicodedata.combining(ch):
            suspects.add(ch)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            suspects.add(chr(int(parts[1], 16)))
    suspects |= {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    low = [c for c in suspects if ord(c) <= 0x2FF]
    assert low == []
    # One text per suspect; the JVM class must find every one of them.
    df = spark.createDataFrame([(c,) for c in suspects], "t string")
    missed = df.filter(~F.col("t").rlike(T.MAY_RECOMPOSE)).collect()
    assert " ".join(hex(ord(r.t)) for r in missed) == ""


def test_language_goldens(spark):
    got = run(spark, [a for a, _ in LANGUAGE], L.detect_language(F.col("t"), F.lit("fallback")))
    assert [g[0] for g in got] == [b for _, b in LANGUAGE]


def test_devanagari_share(spark):
    got = run(spark, ["नमस्ते abc", "abc", "123"], F.round(L.devanagari_share(F.col("t")), 4))
    # न म स त are letters; the vowel signs and the virama are not
    assert [g[0] for g in got] == [round(4 / 7, 4), 0.0, 0.0]


def test_scrub_rewrite(spark):
    texts = ["you IDIOT, shut up", "idiot", "hey , idiot , ok", "fine words", "damn", "sabko bewakoof mat bolo", "तू गधा है"]
    got = [r[0] for r in run(spark, texts, T.scrub_rewrite(F.col("t")))]
    assert got == [
        "You mistaken, please stop talking",
        "Mistaken",
        "Hey, mistaken, ok",
        "Fine words",
        "damn",
        "Sabko naasamajh mat bolo",
        "तू नासमझ है",
    ]


def test_small_string_rules(spark):
    t = F.col("t")
    assert run(spark, ["a b c"], T.word_chunks(t)) == [(["a ", "b ", "c"],)]
    assert run(spark, [" # General "], T.channel_name(t), T.channel_name(t, False)) == [("general", " general")]
    assert run(spark, ['"hi"', "'x'", '"', '"a'], T.strip_quotes(t)) == [("hi",), ("x",), ('"',), ('"a',)]
    assert run(spark, ["x" * 31], T.snippet(t, 30)) == [("x" * 27 + "...",)]
    assert run(spark, ["", None, "be Polite", "ok"], T.is_generic_reply(t)) == [(True,), (True,), (True,), (False,)]
    assert run(spark, ["a @bob http://x.y/z 12"], T.mask_text(t)) == [("a <USER> <URL> <NUM>",)]
    assert run(spark, ["P Clean: hi \nrest", "Clean: ", "other"], T.clean_completion(t)) == [
        ("hi ",), ("(Empty generation)",), ("other",),
    ]
    assert run(spark, ["idiot  fine", "x"], T.simple_scrub(t))[0] == ("fine",)


def test_prompt_keeps_slots_inside_user_text(spark):
    got = run(
        spark,
        ["say {language}"],
        T.rewrite_prompt(F.col("t"), F.lit("en"), F.lit(""), F.array(F.lit("one"), F.lit("two"))),
    )[0][0]
    assert 'Message: "say {language}"' in got and "  [1] one\n  [2] two" in got and "Flagged: Unknown" in got


def test_sql_functions_match_columns(spark):
    names = registry.register(spark)
    assert "mod_nfc" in names
    row = spark.sql(
        "SELECT mod_squeeze('cooool') a, mod_homoglyphs('а') b, mod_severity(0.55D) c, mod_action('HIGH') d, "
        "mod_nfc('é') e, mod_mask('see www.a.b 5') f, mod_sigmoid(0D) g, mod_is_indian_language('hi') h"
    ).first()
    assert tuple(row) == ("cool", "a", "MEDIUM", "BLOCKED", "é", "see <URL> <NUM>", 0.5, True)


def test_sql_text_functions_match_columns(spark):
    registry.register(spark)
    texts = ["  A\tb  \u200bé\n\n\n\nC ", "f.u.n 4 2day", '"hi "', "Please be POLITE", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("sql_texts")
    t = F.col("t")
    want = df.select(
        T.clean_text(t), T.join_separated(t), T.word_count(t), T.is_generic_reply(t), T.training_prompt(t), T.strip_quotes(t)
    ).collect()
    got = spark.sql(
        "SELECT mod_clean(t), mod_join_separated(t), mod_word_count(t), mod_generic_reply(t), mod_training_prompt(t), mod_strip_quotes(t) FROM sql_texts"
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    row = spark.sql(
        "SELECT mod_context(array('a','b','c','d','e'), 4), mod_route(true, false), mod_perplexity(20D), mod_feedback_id('abcdefghij')"
    ).first()
    assert tuple(row) == ("b c d e", "latin", float("inf"), "fb-abcdefgh")
