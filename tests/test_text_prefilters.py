"""Rules that first ask whether a text can change give what they gave without asking."""

from pyspark.sql import functions as F

from modspark import fixed_values as fv
from modspark.functions import lang as L
from modspark.functions import registry
from modspark.functions import text as T

TEXTS = [
    None, "", " ", "plain words", "a  b\tc d   e\x1cf", " , x ,y", "fuidiotck Moron FUCKING end", "id iot　　stupid",
    "kya hai main", "hain kya\x1fkya", "xkya haix", "@joe a@joe @@x_1 é@b", "साला idiot İdiot shut up", "गधा", "bc mc",
    "a.b.c a-b-c ab.c.d", "s​t⁠u﻿", "p@ss $a$ h!t !x", "अआ বাং தமிழ் latin", "ଓ ગુ ਪੰ కన ಕ മ",
]


def test_values(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    t = F.col("t")
    ws = T.WS
    gone = T.strip(t)
    for w in fv.PLAIN_SCRUB_WORDS:
        for form in (w, w.capitalize(), w.upper()):
            gone = F.replace(gone, F.lit(form), F.lit(""))
    gone = F.array_join(T.tokens(gone), " ")
    pairs = {
        "plain": (T.simple_scrub(t), F.when(F.length(gone) < 3, fv.PLAIN_SCRUB_DEFAULT).otherwise(gone)),
        "hits": (L.romanised_hits(t), F.size(F.array_intersect(T.tokens(F.lower(t)), T.literal_words(fv.ROMANISED_HINDI)))),
        "spaces": (T.single_spaces(t), F.btrim(F.regexp_replace(t, f"[{ws}]{{2,}}|[{ws}&&[^ ]]", " "), F.lit(" "))),
        "users": (T.mask_text(t), F.regexp_replace(F.regexp_replace(t, "(?<![A-Za-z0-9_])@[A-Za-z0-9_]+", "<USER>"), "[0-9]+", "<NUM>")),
        "joined": (T.join_separated(t), F.regexp_replace(t, f"(?<=[a-z])[.\\-_{ws}](?=[a-z][.\\-_{ws}][a-z])", "")),
    }
    for name, block, _ in fv.SCRIPT_BLOCKS:
        pairs[name] = (L.script_counts(t)[name], F.coalesce(L.count_in(t, block), F.lit(0)))
    registry.register(spark)
    same = df.select("t", *[a.eqNullSafe(b).alias(n) for n, (a, b) in pairs.items()],
                     F.expr("mod_plain_scrub(t)").eqNullSafe(T.simple_scrub(t)).alias("sql_plain"), F.expr("mod_tidy(t, t)").eqNullSafe(T._tidy(t, t)).alias("sql_tidy"),
                     F.expr("mod_scrub(t)").eqNullSafe(T.scrub_rewrite(t)).alias("sql_scrub"), F.expr("mod_deleet_symbols(mod_deleet_digits(t))").eqNullSafe(T.deleet(t)).alias("sql_deleet"))
    for row in same.collect():
        assert all(row[1:]), row


def test_sql_leet_asks_for_the_symbol_first():
    assert registry._DDL["mod_deleet_symbols"][2].count("contains(") == len(fv.LEET_SYMBOLS)
