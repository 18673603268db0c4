"""Text, language and rewrite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark import fixed_values as fv
from modspark.catalog.common import (
    WORD_SQL,
    WS_SQL,
    clean_sql,
    derived_array,
    documents,
    q,
    query,
    strip_sql,
    table,
    tokens_sql,
)
from modspark.functions import lang as L
from modspark.functions import maths as M
from modspark.functions import registry
from modspark.functions import scores as S
from modspark.functions import text as T
from modspark.operators import feedback as FB
from modspark.operators import langid
from modspark.operators import windows as W
from modspark.operators.profile import script_ratio as script_ratio_of
from modspark.session import spread

c = F.col

# --- clean, normalise ---------------------------------------------------------------

_DECOMPOSED = "Café​ x\t y\n\n\n\nz"
_INJECT = "CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || {v} ELSE text END"


def _with_decomposed(s, d):
    return documents(s, d, "doc_id", "text").withColumn(
        "text",
        F.when(c("doc_id") % 10 == 0, F.concat("text", F.lit("\n" + _DECOMPOSED))).otherwise(c("text")),
    )


@query(
    "clean_text",
    f"SELECT doc_id, {clean_sql(_INJECT.format(v=q(_DECOMPOSED)))} AS cleaned FROM documents",
)
def clean_text(s, d):
    return _with_decomposed(s, d).select("doc_id", T.clean_text(c("text")).alias("cleaned"))


_TO_CYRILLIC = ("aeopcyxABEKMHOPCTX", "аеорсухАВЕКМНОРСТХ")


@query(
    "homoglyph_map",
    f"""SELECT doc_id, translate(translate(text, '{_TO_CYRILLIC[0]}', '{_TO_CYRILLIC[1]}'),
        '{fv.HOMOGLYPH_FROM}', '{fv.HOMOGLYPH_TO}') AS mapped FROM documents""",
)
def homoglyph_map(s, d):
    return documents(s, d, "doc_id", "text").select(
        "doc_id", T.map_homoglyphs(F.translate("text", *_TO_CYRILLIC)).alias("mapped")
    )


def _squeeze_cte(source: str, name: str = "t") -> str:
    """CTE body: squeeze repeats of column ``t`` through its character list."""
    return f"""SELECT doc_id, coalesce(list_aggregate(list_filter(l, lambda x, i: coalesce(
        NOT (i > 2 AND x = l[i - 1] AND x = l[i - 2] AND x <> chr(10)), true)), 'string_agg', ''), '') AS {name}
        FROM (SELECT doc_id, string_split(t, '') AS l FROM {source})"""


def _join_cte(source: str, name: str = "t") -> str:
    sep = rf"'[.\-_{WS_SQL}]'"
    return f"""SELECT doc_id, coalesce(list_aggregate(list_filter(l, lambda x, i: NOT coalesce(
        regexp_full_match(x, {sep}) AND i > 1 AND regexp_full_match(l[i - 1], '[a-z]')
        AND regexp_full_match(l[i + 1], '[a-z]') AND regexp_full_match(l[i + 2], {sep})
        AND regexp_full_match(l[i + 3], '[a-z]'), false)), 'string_agg', ''), '') AS {name}
        FROM (SELECT doc_id, string_split(t, '') AS l FROM {source})"""


def _deleet_cte(source: str, name: str = "t") -> str:
    w, nw = f"[{WORD_SQL}]", f"[^{WORD_SQL}]"
    # lead, core from first to last word character, tail
    core = rf"^({nw}*)({w}(?:(?s:.)*{w})?)({nw}*)$"
    return f"""SELECT doc_id, coalesce(list_aggregate(list_transform(regexp_extract_all(t, '[{WS_SQL}]+|[^{WS_SQL}]+'),
        lambda x: CASE WHEN regexp_matches(x, '{core}') THEN regexp_extract(x, '{core}', 1)
             || translate(regexp_extract(x, '{core}', 2), '013457', 'oieast')
             || regexp_extract(x, '{core}', 3) ELSE x END), 'string_agg', ''), '') AS {name} FROM {source}"""


def _full_deleet_cte(source: str, name: str = "t") -> str:
    return _deleet_cte(source, name).replace("'013457', 'oieast'", "'0134578@$!', 'oieastbasi'")


@query(
    "squeeze_repeats",
    "WITH s AS (SELECT doc_id, replace(replace(text, 'e', 'eeee'), 'th', 'tthhh') || chr(10) || chr(10) || chr(10) AS t FROM documents), "
    f"r AS ({_squeeze_cte('s')}) SELECT doc_id, t AS squeezed FROM r",
)
def squeeze_repeats(s, d):
    stretched = F.concat(
        F.replace(F.replace("text", F.lit("e"), F.lit("eeee")), F.lit("th"), F.lit("tthhh")), F.lit("\n\n\n")
    )
    return documents(s, d, "doc_id", "text").select("doc_id", T.squeeze_repeats(stretched).alias("squeezed"))


_SPACED_SQL = "lower(replace(replace(text, 'the', 't.h.e'), 'an', ' a n d '))"


@query(
    "join_separated_letters",
    f"WITH s AS (SELECT doc_id, {_SPACED_SQL} AS t FROM documents), r AS ({_join_cte('s')}) "
    "SELECT doc_id, t AS joined FROM r",
)
def join_separated_letters(s, d):
    spaced = F.lower(F.replace(F.replace("text", F.lit("the"), F.lit("t.h.e")), F.lit("an"), F.lit(" a n d ")))
    return documents(s, d, "doc_id", "text").select("doc_id", T.join_separated(spaced).alias("joined"))


_LEET = ("aeos", "43@$")


@query(
    "deleet",
    f"WITH s AS (SELECT doc_id, translate(text, '{_LEET[0]}', '{_LEET[1]}') AS t FROM documents), "
    f"r AS ({_full_deleet_cte('s')}) SELECT doc_id, t AS plain FROM r",
)
def deleet(s, d):
    return documents(s, d, "doc_id", "text").select(
        "doc_id", T.deleet(F.translate("text", *_LEET)).alias("plain")
    )


def normalized_ctes(source_sql: str) -> str:
    """CTEs ending in ``norm(doc_id, t)`` from a select of (doc_id, t)."""
    return f"""src AS ({source_sql}),
    n1 AS (SELECT doc_id, translate({clean_sql('t')}, '{fv.HOMOGLYPH_FROM}', '{fv.HOMOGLYPH_TO}') AS t FROM src),
    n2 AS ({_squeeze_cte('n1')}), n3 AS ({_join_cte('n2')}), norm AS ({_full_deleet_cte('n3')})"""


@query(
    "normalize_for_toxicity",
    f"WITH {normalized_ctes('SELECT doc_id, ' + _INJECT.format(v=q(_DECOMPOSED)) + ' AS t FROM documents')} "
    "SELECT doc_id, t AS normalized FROM norm",
)
def normalize_for_toxicity(s, d):
    return _with_decomposed(s, d).select("doc_id", T.normalize_for_toxicity(c("text")).alias("normalized"))


# --- scripts and languages -----------------------------------------------------------

_ABC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DEV = "अआइईउऊएऐओऔकखगघचछजझटठडढणतथद"
_BEN = "অআইঈউঊএঐওঔকখগঘচছজঝটঠডঢণতথদ"

_MIXED_SQL = f"""CASE doc_id % 6 WHEN 0 THEN translate(text, '{_ABC}', '{_DEV * 2}')
    WHEN 1 THEN translate(text, 'aeiou', 'अएइओउ') WHEN 2 THEN translate(text, '{_ABC[:20]}', '{_BEN[:20]}')
    WHEN 3 THEN text || ' kya hai' WHEN 4 THEN text || ' main' ELSE text END"""


def _mixed(s, d):
    t = c("text")
    which = c("doc_id") % 6
    return documents(s, d, "doc_id", "lang", "text").withColumn(
        "text",
        F.when(which == 0, F.translate(t, _ABC, _DEV * 2))
        .when(which == 1, F.translate(t, "aeiou", "अएइओउ"))
        .when(which == 2, F.translate(t, _ABC[:20], _BEN[:20]))
        .when(which == 3, F.concat(t, F.lit(" kya hai")))
        .when(which == 4, F.concat(t, F.lit(" main")))
        .otherwise(t),
    )


def _n(e: str, cls: str) -> str:
    return f"length(regexp_replace({e}, '[^{cls}]', '', 'g'))"


def _block_sql(block: str) -> str:
    lo, hi = block.split("-")
    return f"\\x{{{lo[2:]}}}-\\x{{{hi[2:]}}}"


@query(
    "script_profile",
    "WITH s AS (SELECT doc_id, " + _MIXED_SQL + " AS t FROM documents) SELECT doc_id, "
    + ", ".join(f"{_n('t', _block_sql(b))}::INTEGER AS {n}" for n, b, _ in fv.SCRIPT_BLOCKS)
    + f", {_n('t', 'a-zA-Z')}::INTEGER AS latin FROM s",
)
def script_profile(s, d):
    return _mixed(s, d).select("doc_id", L.script_counts(c("text")).alias("s")).select("doc_id", "s.*")


@query(
    "script_ratio",
    "WITH s AS (SELECT " + _MIXED_SQL + " AS t FROM documents), "
    r"n AS (SELECT sum(" + _n("t", r"\x00-\x7F") + ")::BIGINT AS ascii, "
    r"sum(" + _n("t", r"\x{900}-\x{97F}") + ")::BIGINT AS devanagari, sum(length(t))::BIGINT AS total FROM s) "
    "SELECT ascii, devanagari, (total - ascii - devanagari)::BIGINT AS other, total, "
    "round(ascii * 100::DOUBLE / total, 4) AS ascii_pct, round(devanagari * 100::DOUBLE / total, 4) AS devanagari_pct, "
    "round(100 - ascii * 100::DOUBLE / total - devanagari * 100::DOUBLE / total, 4) AS other_pct FROM n",
)
def script_ratio(s, d):
    out = script_ratio_of(_mixed(s, d), "text")
    return out.select(
        "ascii", "devanagari", "other", "total",
        *[F.round(n, 4).alias(n) for n in ("ascii_pct", "devanagari_pct", "other_pct")],
    )


_LEX_SQL = "[" + ", ".join(q(w) for w in fv.ROMANISED_HINDI) + "]"
# Reads s (doc_id, lang, t), where lang is what another detector says.
RULES_SQL = f"""n AS (SELECT *, {', '.join(f"{_n('t', _block_sql(b))} AS n_{name}" for name, b, _ in fv.SCRIPT_BLOCKS)},
   {_n('t', 'a-zA-Z')} AS latin, list_distinct({tokens_sql('lower(t)')}) AS toks FROM s),
 m AS (SELECT *, {' + '.join('n_' + name for name, _, _ in fv.SCRIPT_BLOCKS)} AS indian,
   greatest({', '.join('n_' + name for name, _, _ in fv.SCRIPT_BLOCKS)}) AS top,
   len(list_intersect(toks, {_LEX_SQL})) AS hits, len(toks) AS n_toks FROM n),
 o AS (SELECT *, CASE {' '.join(f"WHEN n_{name} = top THEN '{code}'" for name, _, code in fv.SCRIPT_BLOCKS)} END AS code FROM m)
 SELECT doc_id, CASE WHEN {strip_sql('t')} = '' THEN 'en'
   WHEN indian > 0 AND latin::DOUBLE / (latin + indian) > 0.2 THEN CASE WHEN code = 'hi' THEN 'hi-en' ELSE 'indic-en' END
   WHEN indian > 0 THEN code
   WHEN latin = 0 THEN 'en'
   WHEN hits >= 2 OR (hits >= 1 AND n_toks <= 5) THEN 'hi-en'
   WHEN lang = 'hi' THEN 'hi-en' ELSE lang END AS language FROM o"""


@query("detect_language", f"WITH s AS (SELECT doc_id, lang, {_MIXED_SQL} AS t FROM documents), {RULES_SQL}")
def detect_language(s, d):
    return _mixed(s, d).select("doc_id", L.detect_language(c("text"), c("lang")).alias("language"))


@query(
    "romanized_hits",
    f"""WITH s AS (SELECT doc_id, list_distinct({tokens_sql('lower(text)')}) AS toks FROM documents)
    SELECT doc_id, len(list_intersect(toks, ['the', 'and', 'der', 'die', 'le', 'la', 'que', 'of']))::INTEGER AS hits,
    len(toks)::INTEGER AS distinct_tokens FROM s""",
)
def romanized_hits(s, d):
    words = ["the", "and", "der", "die", "le", "la", "que", "of"]
    return documents(s, d, "doc_id", "text").select(
        "doc_id",
        L.romanised_hits(c("text"), words).alias("hits"),
        F.size(L.distinct_tokens(c("text"))).alias("distinct_tokens"),
    )


LANGUAGES = ["de", "en", "es", "fr"]


def _predicted_sql(text: str) -> str:
    return f"""g AS (SELECT doc_id, lang, unnest(list_concat(regexp_extract_all(t, '(?s).{{3}}'),
     regexp_extract_all(t[2:], '(?s).{{3}}'), regexp_extract_all(t[3:], '(?s).{{3}}'))) AS gram
     FROM (SELECT doc_id, lang, lower({text}) AS t FROM documents)),
    per AS (SELECT gram, {', '.join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in LANGUAGES)} FROM g GROUP BY gram),
    kept AS (SELECT * FROM per WHERE de + en + es + fr > 0),
    sums AS (SELECT count(*) AS size, {', '.join(f"sum({x}) AS s_{x}" for x in LANGUAGES)} FROM kept),
    w AS (SELECT gram, {', '.join(f"round(1000 * ln(({x} + 1)::DOUBLE / (s_{x} + size)))::BIGINT AS {x}" for x in LANGUAGES)} FROM kept, sums),
    sc AS (SELECT doc_id, {', '.join(f"sum({x}) AS {x}" for x in LANGUAGES)} FROM g JOIN w USING (gram) GROUP BY doc_id),
    pred AS (SELECT doc_id, CASE greatest(sc.de, sc.en, sc.es, sc.fr) WHEN sc.de THEN 'de' WHEN sc.en THEN 'en'
      WHEN sc.es THEN 'es' WHEN sc.fr THEN 'fr' END AS predicted FROM sc)"""


def _with_predicted(docs):
    """In the row, or by a join where the profiles are too large for that."""
    profiles = langid.train_profiles(docs, LANGUAGES, "text", "lang")
    in_row = langid.predictor(profiles, LANGUAGES)
    if in_row is not None:
        return docs.withColumn("predicted", in_row(c("text")))
    return docs.join(langid.identify(docs, profiles, LANGUAGES, "doc_id", "text", max_bytes=0), "doc_id")


@query("ngram_langid", f"WITH {_predicted_sql('text')} SELECT d.doc_id, d.lang, predicted FROM documents d LEFT JOIN pred USING (doc_id)")
def ngram_langid(s, d):
    return _with_predicted(documents(s, d, "doc_id", "lang", "text")).select("doc_id", "lang", "predicted")


@query(
    "detect_language_trained",
    f"""WITH {_predicted_sql(_MIXED_SQL)}, s AS (SELECT doc_id, coalesce(predicted, 'en') AS lang, {_MIXED_SQL} AS t FROM documents LEFT JOIN pred USING (doc_id)), {RULES_SQL}""",
)
def detect_language_trained(s, d):
    """The trained detector decides where neither script nor indicator words do."""
    rest = langid.fallback_column(c("predicted"))
    return _with_predicted(_mixed(s, d)).select("doc_id", L.detect_language(c("text"), rest).alias("language"))


@query(
    "curation_filter",
    f"""WITH s AS (SELECT doc_id, {strip_sql(_MIXED_SQL)} AS t FROM documents),
    m AS (SELECT doc_id, t, regexp_matches(t, '[\\x{{900}}-\\x{{97F}}]') AS has_devanagari,
      length(regexp_replace(t, '\\PL', '', 'g')) AS letters,
      length(regexp_replace(regexp_replace(t, '\\PL', '', 'g'), '[^\\x{{900}}-\\x{{97F}}]', '', 'g')) AS dev FROM s WHERE length(t) > 1)
    SELECT doc_id, has_devanagari, round(CASE WHEN letters > 0 THEN dev::DOUBLE / letters ELSE 0 END, 6) AS devanagari_share,
      coalesce(CASE WHEN letters > 0 THEN dev::DOUBLE / letters ELSE 0 END > 0.3, false) AS devanagari_text,
      (NOT has_devanagari AND length(t) < 110) AS candidate FROM m""",
)
def curation_filter(s, d):
    from modspark.plans.corpus import usable_text

    t = c("text")
    return usable_text(_mixed(s, d)).select(
        "doc_id",
        L.has_devanagari(t).alias("has_devanagari"),
        F.round(L.devanagari_share(t), 6).alias("devanagari_share"),
        L.is_devanagari_text(t).alias("devanagari_text"),
        (~L.has_devanagari(t) & (F.length(t) < fv.PLAIN_SCRUB_MAX_CHARS)).alias("candidate"),
    )


_NAMES_SQL = "CASE lang " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.LANGUAGE_NAMES.items()) + " ELSE lang END"
_REPLY_SQL = (
    "CASE lang " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.REPLY_TEMPLATES.items())
    + f" ELSE {q(fv.REPLY_TEMPLATES['en'])} END"
)


@query(
    "code_lookup",
    f"""SELECT doc_id, {_NAMES_SQL} AS language_name, {_REPLY_SQL} AS reply,
    lang IN ({', '.join(q(x) for x in fv.INDIAN_CODES)}) AS indian,
    CASE doc_id % 4 WHEN 0 THEN 'Safe' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS severity_name
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hi-en' ELSE lang END AS lang FROM documents)""",
)
def code_lookup(s, d):
    docs = table(s, d, "documents").select(
        "doc_id", F.when(c("doc_id") % 3 == 0, "hi-en").otherwise(c("lang")).alias("lang")
    )
    return docs.select(
        "doc_id",
        T.language_name(c("lang")).alias("language_name"),
        T.reply_template(c("lang")).alias("reply"),
        L.is_indian_language(c("lang")).alias("indian"),
        T.lookup((c("doc_id") % 4).cast("int"), fv.SEVERITY_NAMES).alias("severity_name"),
    )


# --- rewrites ------------------------------------------------------------------------

# Words of the invented prose, rewritten by the same machinery as the default rules.
PROSE_RULES = [
    ("idiot|moron|clown", "mistaken", True),
    ("worthless|pathetic|scum", "", True),
    ("that the", "which the", True),
    ("thor", "oak", False),
]


def _rule_sql(e: str) -> str:
    """The prose rules over single spaces: a second pass catches words that share one."""
    w = f"[^{WORD_SQL}]"
    for words, repl, whole in PROSE_RULES:
        if whole:
            p = f"(?i)(^|{w})(?:{words})(?={w}|$)"
            # RE2 has no look-ahead: guard every word boundary with a marker instead.
            p = f"(?i)(^|{w})(?:{words})($|{w})"
            once = rf"regexp_replace({{e}}, '{p}', '\1{repl}\2', 'g')"
            e = once.replace("{e}", once.replace("{e}", e))
        else:
            e = f"regexp_replace({e}, '(?i){words}', '{repl}', 'g')"
    return e


_SCRUB_SQL = f"""WITH r AS (SELECT doc_id, text, {_rule_sql('text')} AS t FROM documents),
  w AS (SELECT doc_id, text, trim(regexp_replace(t, '[{WS_SQL}]+', ' ', 'g'), ' ') AS t FROM r),
  k AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, ' , *', ', ', 'g'), '^ *, *', '') AS t FROM w)
  SELECT doc_id, CASE WHEN length(t) > 2 THEN upper(t[1]) || t[2:] ELSE text END AS rewritten FROM k"""


@query("scrub_rewrite", _SCRUB_SQL)
def scrub_rewrite(s, d):
    return documents(s, d, "doc_id", "text").select(
        "doc_id", T.scrub_rewrite(c("text"), PROSE_RULES).alias("rewritten")
    )


def simple_scrub_sql(e: str) -> str:
    t = strip_sql(e)
    for w in fv.PLAIN_SCRUB_WORDS:
        for form in (w, w.capitalize(), w.upper()):
            t = f"replace({t}, '{form}', '')"
    t = f"array_to_string({tokens_sql(t)}, ' ')"
    return t


@query(
    "simple_scrub",
    f"""WITH s AS (SELECT doc_id, {simple_scrub_sql('text')} AS t FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT doc_id, CASE WHEN length(t) < 3 THEN {q(fv.PLAIN_SCRUB_DEFAULT)} ELSE t END AS clean_text FROM s""",
)
def simple_scrub(s, d):
    toxic = table(s, d, "labels").filter("toxic = 1").select("doc_id")
    return (
        documents(s, d, "doc_id", "text")
        .join(toxic, "doc_id", "left_semi")
        .select("doc_id", T.simple_scrub(c("text")).alias("clean_text"))
    )


@query(
    "generic_reply_flag",
    "WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Please stay Polite. ' || text WHEN 1 THEN '' ELSE text END AS t FROM conversations) "
    "SELECT conv_id, turn, (t = '' OR " + " OR ".join(f"contains(lower(t), {q(p)})" for p in fv.GENERIC_REPLY_PHRASES) + ") AS generic FROM m",
)
def generic_reply_flag(s, d):
    t = (
        F.when(c("turn") % 4 == 0, F.concat(F.lit("Please stay Polite. "), c("text")))
        .when(c("turn") % 4 == 1, "")
        .otherwise(c("text"))
    )
    return table(s, d, "conversations").select("conv_id", "turn", T.is_generic_reply(t).alias("generic"))


@query(
    "masked_text",
    r"""SELECT 'document' AS kind, doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text,
      '(?i)(?:https?://|www\.)[^\s<>"'']+', '<URL>', 'g'), '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]+', '\1<USER>', 'g'), '[0-9]+', '<NUM>', 'g') AS masked FROM documents
    UNION ALL SELECT 'page', page_id, regexp_replace(regexp_replace(regexp_replace('see ' || url || ' by @page' || page_id || ' no ' || page_id,
      '(?i)(?:https?://|www\.)[^\s<>"'']+', '<URL>', 'g'), '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]+', '\1<USER>', 'g'), '[0-9]+', '<NUM>', 'g') FROM pages""",
)
def masked_text(s, d):
    docs = documents(s, d, "doc_id", "text").select(
        F.lit("document").alias("kind"), c("doc_id").alias("id"), T.mask_text(c("text")).alias("masked")
    )
    p = c("page_id").cast("string")
    line = F.concat(F.lit("see "), c("url"), F.lit(" by @page"), p, F.lit(" no "), p)
    pages = table(s, d, "pages").select(
        F.lit("page").alias("kind"), c("page_id").alias("id"), T.mask_text(line).alias("masked")
    )
    return docs.unionByName(pages)


# --- prompts, templates, chunks ------------------------------------------------------

_CTX_SQL = "list_reverse(list_reverse(h)[1:4])"


@query(
    "prompt_text",
    f"""WITH t AS (SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM conversations),
    p AS (SELECT *, coalesce({_CTX_SQL}, []) AS l FROM t)
    SELECT conv_id, turn, 'Rewrite the chat message below without abuse and keep what the sender means.' || chr(10) || 'Message: "' || text || '"' || chr(10)
      || 'Flagged: ' || CASE WHEN turn % 2 = 0 THEN 'Unknown' ELSE 'toxic: 0.90' END || chr(10) || 'Language: '
      || CASE WHEN turn % 3 = 0 THEN 'English' ELSE 'fr' END || chr(10)
      || CASE WHEN len(l) > 0 THEN 'Earlier turns:' || chr(10) || array_to_string(list_transform(l, lambda x, i: '  [' || i || '] ' || x), chr(10)) || chr(10) ELSE '' END
      || 'Reply with the rewritten message only, in the same language.' AS prompt,
      'Rewrite this toxic text politely without any abuse:' || chr(10) || 'Toxic: ' || text || chr(10) || 'Clean:' AS training_prompt
    FROM p""",
)
def prompt_text(s, d):
    from modspark.operators.windows import history

    turns = history(table(s, d, "conversations").drop("role"), "conv_id", "turn", "text")
    return turns.select(
        "conv_id",
        "turn",
        T.rewrite_prompt(
            c("text"),
            F.when(c("turn") % 3 == 0, "en").otherwise("fr"),
            F.when(c("turn") % 2 == 0, "").otherwise("toxic: 0.90"),
            c("history"),
        ).alias("prompt"),
        T.training_prompt(c("text")).alias("training_prompt"),
    )


@query(
    "completion_cleanup",
    f"""WITH m AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Toxic: x' || chr(10) || 'Clean: ' || text
      WHEN 1 THEN 'Toxic: x' || chr(10) || 'Clean:  ' ELSE 'Prompt ' || text END AS full_text, text FROM conversations),
    p AS (SELECT *, {strip_sql("split_part(full_text, 'Clean:', -1)")} AS tail FROM m)
    SELECT conv_id, turn, CASE WHEN contains(full_text, 'Clean:') THEN CASE WHEN split_part(tail, chr(10), 1) = '' THEN '(Empty generation)'
      ELSE split_part(tail, chr(10), 1) END ELSE {strip_sql("replace(full_text, 'Prompt ', '')")} END AS completion,
      {strip_sql('text')} AS unquoted FROM p""",
)
def completion_cleanup(s, d):
    t = c("text")
    full = (
        F.when(c("turn") % 3 == 0, F.concat(F.lit("Toxic: x\nClean: "), t))
        .when(c("turn") % 3 == 1, F.lit("Toxic: x\nClean:  "))
        .otherwise(F.concat(F.lit("Prompt "), t))
    )
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    return table(s, d, "conversations").select(
        "conv_id",
        "turn",
        T.clean_completion(full, F.lit("Prompt ")).alias("completion"),
        T.strip_quotes(quoted).alias("unquoted"),
    )


@query(
    "template_fill",
    "SELECT doc_id, 'From ' || source || ' in ' || lang || ': ' || text AS filled FROM documents",
)
def template_fill(s, d):
    return table(s, d, "documents").select(
        "doc_id",
        T.fill_template(
            "From {source} in {lang}: {text}", {"source": c("source"), "lang": c("lang"), "text": c("text")}
        ).alias("filled"),
    )


@query(
    "snippet",
    "SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE substr(text, 1, 27) || '...' END AS snippet FROM documents",
)
def snippet(s, d):
    return table(s, d, "documents").select("doc_id", T.snippet(c("text"), 30).alias("snippet"))


@query(
    "word_chunks",
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)
    SELECT conv_id, turn, (i - 1)::INTEGER AS seq, ws[i] || CASE WHEN i < len(ws) THEN ' ' ELSE '' END AS chunk
    FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)""",
)
def word_chunks(s, d):
    return table(s, d, "conversations").select(
        "conv_id", "turn", F.posexplode(T.word_chunks(c("text"))).alias("seq", "chunk")
    )


@query(
    "channel_names",
    """SELECT name, count(*) AS customers FROM (SELECT trim(regexp_replace(lower(trim(raw)), '^#', '')) AS name
      FROM (SELECT ' # ' || c_mktsegment || ' ' AS raw FROM customer)) GROUP BY name""",
)
def channel_names(s, d):
    raw = F.concat(F.lit(" # "), c("c_mktsegment"), F.lit(" "))
    names = table(s, d, "customer").select(T.channel_name(raw).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("customers")).orderBy("name")


@query(
    "email_keys",
    "SELECT c_custkey, lower(c_name || '@Example.COM') AS email FROM customer",
)
def email_keys(s, d):
    return (
        table(s, d, "customer")
        .select("c_custkey", T.email_key(F.concat("c_name", F.lit("@Example.COM"))).alias("email"))
    )


@query(
    "sql_functions",
    """SELECT doc_id, CASE WHEN s < 0.30 THEN 'SAFE' WHEN s < 0.55 THEN 'LOW' WHEN s < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
      CASE WHEN length(source) <= 4 THEN source ELSE substr(source, 1, 1) || '...' END AS short_source,
      trim(regexp_replace(lower(trim('#' || lang)), '^#', '')) AS channel, false AS devanagari
    FROM (SELECT doc_id, source, lang, (doc_id % 101) / 100::DOUBLE AS s FROM documents)""",
)
def sql_functions(s, d):
    registry.register(s)
    table(s, d, "documents").createOrReplaceTempView("modspark_documents")
    return s.sql(
        """SELECT doc_id, mod_severity((doc_id % 101) / 100D) AS severity, mod_snippet(source, 4) AS short_source,
        mod_channel_name(concat('#', lang)) AS channel, mod_has_devanagari(source) AS devanagari FROM modspark_documents"""
    )


def _sql_pairs():
    """Every scalar SQL function next to the Column function of the same rule."""
    t, x, s = c("text"), c("x"), c("s")
    turns = F.split(t, " ")
    probe = F.concat(F.lit('"'), F.substring(t, 1, 40), F.lit('"'))
    plain = [
        ("severity", "x", S.severity(x)), ("action", "mod_severity(x)", S.action(S.severity(x))), ("is_toxic", "x", S.is_toxic(x)),
        ("squeeze", "text", T.squeeze_repeats(t)), ("homoglyphs", "text", T.map_homoglyphs(t)), ("channel_name", "concat(' #', source)", T.channel_name(F.concat(F.lit(" #"), "source"))),
        ("snippet", "text, 20", T.snippet(t, 20)), ("has_devanagari", "text", L.has_devanagari(t)), ("is_indian_language", "lang", L.is_indian_language(c("lang"))),
        ("mask", "text", T.mask_text(t)), ("sigmoid", "x", M.sigmoid(x)), ("softplus", "x - 0.5D", M.softplus(x - 0.5)), ("perplexity", "x * 30", M.perplexity(x * 30)),
        ("safe_divide", "1D, x", M.safe_divide(F.lit(1.0), x)), ("strip", "text", T.strip(t)), ("word_count", "text", T.word_count(t)), ("clean", "text", T.clean_text(t)),
        ("join_separated", "text", T.join_separated(t)), ("deleet_digits", "text", F.translate(t, fv.LEET_DIGITS_FROM, fv.LEET_DIGITS_TO)),
        ("strip_quotes", """concat('"', left(text, 40), '"')""", T.strip_quotes(probe)), ("email_key", "text", T.email_key(t)), ("feedback_id", "text", FB.feedback_id(t)),
        ("training_prompt", "text", T.training_prompt(t)), ("generic_reply", "text", T.is_generic_reply(t)), ("needs_rewrite", "x > 0.3, mod_severity(x)", S.needs_rewrite(x > 0.3, S.severity(x))),
        ("route", "x > 0.3, mod_has_devanagari(text)", S.route(x > 0.3, L.has_devanagari(t))), ("top_score", "s", F.array_max(s)), ("context", "split(text, ' '), 4", W.context_string(turns)),
        ("deleet_symbols", "mod_deleet_digits(text)", T.deleet(t)), ("normalize", "text", T.normalize_for_toxicity(t)), ("script_counts", "text", L.script_counts(t)),
        ("language_of_counts", "mod_script_counts(concat(text, 'अ'))", T.bind(L.script_counts(F.concat(t, F.lit("अ"))), L._by_script)), ("romanised_hits", "text", L.romanised_hits(t)), ("language", "text, lang", L.detect_language(t, c("lang"))),
        ("scrub", "text", T.scrub_rewrite(t)), ("tidy", "text, source", T._tidy(t, c("source"))), ("plain_scrub", "text", T.simple_scrub(t)),
        ("lexicon_points", "lower(text)", S.lexicon_points(F.lower(t))), ("lexicon_scores", "lower(text)", S.lexicon_scores(F.lower(t))), ("gate", "s, x", S.gate(s, x)),
        ("tag_triggers", "s, 0.5D", S.tag_triggers(s)), ("top_tag", "s", S.top_tag(s)), ("nfc", "text", T.nfc(t)),
    ]
    return [(f"mod_{name}", f"mod_{name}({call})", column) for name, call, column in plain]


_PAIRED = ", ".join(q(name) for name in [*registry._DDL, "mod_nfc"])


@query("sql_functions_equal", f"SELECT unnest([{_PAIRED}]) AS name, rows, rows AS equal FROM (SELECT count(*) AS rows FROM documents)")
def sql_functions_equal(s, d):
    """How many documents give the same by the SQL name and by the Column, for every registered name."""
    registry.register(s)
    rows = _mixed(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.withColumn("x", (c("doc_id") % 101) / 100.0).withColumn("s", derived_array("doc_id"))
    pairs = _sql_pairs()
    same = rows.select(*[F.expr(call).eqNullSafe(column).alias(name) for name, call, column in pairs])
    counts = same.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(name).alias(name) for name, _, _ in pairs])
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("equal")) for name, _, _ in pairs])
    return counts.select("rows", F.inline(entries)).select("name", "rows", "equal")


@query(
    "sql_table_functions",
    """SELECT conv_id, turn, unnest(range(len(w)))::INTEGER AS seq, unnest(list_transform(w, lambda x, i: CASE WHEN i < len(w) THEN x || ' ' ELSE x END)) AS chunk, 0 AS batch
      FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
    UNION ALL SELECT conv_id, turn, unnest([0, 1])::INTEGER, unnest([role, text]), 1 FROM conversations""",
)
def sql_table_functions(s, d):
    registry.register(s)
    table(s, d, "conversations").createOrReplaceTempView("modspark_conversations")
    return s.sql(
        """SELECT conv_id, turn, seq, chunk, 0 AS batch FROM modspark_conversations, LATERAL mod_chunks(text)
        UNION ALL SELECT conv_id, turn, position, message, 1 FROM modspark_conversations, LATERAL mod_batch(array(role, text))"""
    )


__all__ = ["LANGUAGES", "normalized_ctes", "spread"]
