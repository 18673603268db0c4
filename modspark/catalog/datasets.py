"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark import constants as k
from modspark import fixed_values as fv
from modspark import schemas
from modspark.catalog.common import WS_SQL, documents, hash_int_sql, md5_sql, query, strip_sql, table, tokens_sql
from modspark.catalog.texts import simple_scrub_sql
from modspark.functions import text as T
from modspark.functions.maths import round_exact
from modspark.operators import monitor, profile, tables
from modspark.operators.ordinal import range_bucket
from modspark.plans import corpus
from modspark.session import scratch_path
from modspark.sources import readers, sinks

c = F.col


@query(
    "dedup_keep_first",
    "SELECT doc_id, text, (SELECT count(DISTINCT text) FROM documents) AS distinct_texts FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def dedup_keep_first(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    kept = tables.keep_first(docs, c("text"), "doc_id")
    return kept.withColumn("distinct_texts", docs.agg(F.count_distinct(F.sha2("text", 256))).scalar())


_UNIFY_SQL = f"""WITH a AS (SELECT 0 AS r, doc_id AS i, text, 'english (documents)' AS source_language, coalesce(toxic, 0) AS toxic, 0 AS severe_toxic,
     (coalesce(toxic, 0) = 1 AND quality = 0)::INTEGER AS obscene, 0 AS threat, coalesce(toxic, 0) AS insult, 0 AS identity_hate FROM documents LEFT JOIN labels USING (doc_id)),
  b AS (SELECT 1, conv_id * 1000 + turn, text, l, y, 0, 0, 0, y, CASE WHEN contains(l, 'hinglish') THEN y ELSE 0 END
     FROM (SELECT *, CASE WHEN role = 'system' THEN 'english' ELSE 'hinglish' END AS l, (turn % 2)::INTEGER AS y FROM conversations)),
  e AS (SELECT 2, item_id, coalesce(CASE WHEN item_id % 4 <> 0 THEN text END, '  raw ' || text), 'hindi/hinglish (classes)', (item_id % 2 = 0)::INTEGER, 0,
     (item_id % 3 = 0)::INTEGER, 0, (item_id % 3 = 1 OR item_id % 2 = 0)::INTEGER, (item_id % 3 = 2)::INTEGER FROM benchmark),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e),
  t AS (SELECT r, i, {strip_sql('text')} AS text, * EXCLUDE (r, i, text) FROM u)
  SELECT r::BIGINT * 17592186044416 + i AS row_order, * EXCLUDE (r, i) FROM t WHERE length(text) > 1 QUALIFY row_number() OVER (PARTITION BY text ORDER BY r, i) = 1"""


def unified(s, d):
    labels = table(s, d, "labels")
    docs = table(s, d, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    toxic = F.coalesce(c("toxic"), F.lit(0))
    comments = docs.select(
        c("text").alias("comment_text"),
        c("doc_id").alias("row_idx"),
        toxic.alias("toxic"),
        F.lit(0).alias("severe_toxic"),
        F.coalesce((toxic == 1) & (c("quality") == 0), F.lit(False)).cast("int").alias("obscene"),
        F.lit(0).alias("threat"),
        toxic.alias("insult"),
        F.lit(0).alias("identity_hate"),
    )
    binary = table(s, d, "conversations").select(
        "text",
        (c("turn") % 2).cast("int").alias("label"),
        F.when(c("role") == "system", "english").alias("lang"),
        (c("conv_id") * 1000 + c("turn")).alias("row_idx"),
    )
    code = c("item_id") % 3
    classed = table(s, d, "benchmark").select(
        F.when(c("item_id") % 4 != 0, c("text")).alias("cleaned Tweets"),
        F.concat(F.lit("  raw "), c("text")).alias("rawtweets"),
        F.when(c("item_id") % 2 == 0, "hof").otherwise("NOT").alias("binary class"),
        F.when(code == 0, "prfn").when(code == 1, "OFFN").otherwise("Hate").alias("Context class"),
        c("item_id").alias("row_idx"),
    )
    return corpus.unify(
        [
            corpus.from_comments(comments, "english (documents)"),
            corpus.from_binary(binary),
            corpus.from_classes(classed),
        ]
    )


@query("unify_sources", _UNIFY_SQL.replace("coalesce(toxic, 0) = 1 AND quality = 0", "coalesce(coalesce(toxic, 0) = 1 AND quality = 0, false)"))
def unify_sources(s, d):
    return unified(s, d)


_COMBO = "PARTITION BY quality, toxic"


@query(
    "stratified_split",
    f"""WITH p AS (SELECT doc_id, quality, toxic, (row_number() OVER ({_COMBO} ORDER BY {md5_sql(42, 'doc_id')}) - 1) % 10 AS fold FROM labels)
    SELECT doc_id, quality, toxic, fold::INTEGER AS fold, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM p""",
)
def stratified_split(s, d):
    return tables.stratified_split(table(s, d, "labels"), ["quality", "toxic"], 42, "doc_id")


@query(
    "kfold_table",
    f"SELECT doc_id, toxic, ((row_number() OVER (ORDER BY {md5_sql(42, 'doc_id')}) - 1) % 3)::INTEGER AS fold FROM labels",
)
def kfold_table(s, d):
    return tables.kfold(table(s, d, "labels").select("doc_id", "toxic"), 3, 42, "doc_id")


@query(
    "rare_rescue",
    f"""WITH x AS (SELECT *, toxic = 1 AS rare FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE rare) AS r, count(*) // 4 AS cap FROM x),
    f AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_sql(42, 'doc_id')}) AS pos FROM x WHERE NOT rare)
    SELECT doc_id, quality, toxic FROM x WHERE rare UNION ALL
    SELECT x.doc_id, quality, toxic FROM x JOIN f USING (doc_id), n WHERE pos <= greatest(0, 100 - r)""",
)
def rare_rescue(s, d):
    return tables.rescue_rare(table(s, d, "labels"), 100, 42, "doc_id", c("toxic") == 1)


@query(
    "rare_complement",
    "SELECT doc_id, quality, toxic, coalesce(toxic = 1 OR quality = 0, false) AS rare, NOT coalesce(toxic = 1 OR quality = 0, false) AS common FROM documents LEFT JOIN labels USING (doc_id)",
)
def rare_complement(s, d):
    joined = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    rare = F.coalesce((c("toxic") == 1) | (c("quality") == 0), F.lit(False))
    hit, rest = joined.filter(rare), joined.filter(~rare)
    return hit.select("*", F.lit(True).alias("rare"), F.lit(False).alias("common")).unionByName(
        rest.select("*", F.lit(False).alias("rare"), F.lit(True).alias("common"))
    )


@query(
    "seeded_sample",
    f"SELECT doc_id, lang FROM documents ORDER BY {md5_sql(42, 'doc_id')} LIMIT 300",
)
def seeded_sample(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang")
    return tables.shuffled(tables.sample_n(docs, 300, 42, "doc_id"), 7, "doc_id")


_MIX = {"en": 0.35, "fr": 0.30, "de": 0.25, "es": 0.10}


@query(
    "language_mix",
    f"""WITH s(lang, share) AS (VALUES ('en', 0.35::DOUBLE), ('fr', 0.30::DOUBLE), ('de', 0.25::DOUBLE), ('es', 0.10::DOUBLE)),
    n AS (SELECT lang, share, count(*) AS n FROM documents JOIN s USING (lang) GROUP BY ALL), t AS (SELECT floor(min(n / share)) AS total FROM n),
    p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {md5_sql(42, 'doc_id')}) AS pos FROM documents)
    SELECT doc_id, lang FROM p JOIN s USING (lang), t WHERE pos <= floor(total * share + 1e-9)""",
)
def language_mix(s, d):
    return tables.resample_mix(table(s, d, "documents").select("doc_id", "lang"), "lang", _MIX, 42, "doc_id")


@query(
    "simple_splits",
    f"""WITH n AS (SELECT count(*) AS n FROM documents), b AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(0.8::DOUBLE * n.n) THEN 'train' ELSE 'val' END AS ordered,
      CASE WHEN {hash_int_sql(42, 'doc_id')} < {int(0.9 * 16**7)} THEN 'train' ELSE 'val' END AS hashed,
      CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY {md5_sql(42, 'doc_id')}) - 1 < floor(0.94::DOUBLE * b.n) THEN 'train' ELSE 'val' END AS by_class
    FROM documents d JOIN b USING (lang), n""",
)
def simple_splits(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang")
    ordered = tables.ordered_split(docs, c("doc_id"), range_bucket(docs, c("doc_id")), 0.8)
    hashed = tables.hash_split(docs, 42, "doc_id", 0.9)
    classed = tables.class_split(docs, "lang", 42, "doc_id", 0.94)
    pick = lambda df, name: df.select("doc_id", c("split").alias(name))
    return pick(ordered, "ordered").join(pick(hashed, "hashed"), "doc_id").join(pick(classed, "by_class"), "doc_id")


# --- rewrite pairs -------------------------------------------------------------------

PAIR_CATEGORIES = [
    {
        "type": "insult",
        "templates": ["you are such a {slur}", "only a {slur} would say that", "stop it, {slur}"],
        "clean": ["I think you are wrong", "I see this differently, {slur} or not", "please stop"],
        "slots": {"slur": ["fool", "clown", "loser", "freak"]},
    },
    {
        "type": "threat",
        "templates": ["do {action} again and you will regret it", "no more {action} or else"],
        "clean": ["please do not do {action} again", "I would like less {action}"],
        "slots": {"action": ["drama", "tricks", "noise"]},
    },
]


def _pairs_sql(paired: bool) -> str:
    h = lambda seed: hash_int_sql(seed, "doc_id")
    arms = []
    for i, cat in enumerate(PAIR_CATEGORIES):
        (slot, values), = cat["slots"].items()
        lst = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
        t = f"({h('42t')} % {len(cat['templates'])} + 1)"
        p = t if paired else f"({h('42p')} % {len(cat['clean'])} + 1)"
        value = f"{lst(values)}[{h('42' + slot)} % {len(values)} + 1]"
        toxic = f"replace({lst(cat['templates'])}[{t}], '{{{slot}}}', {value})"
        clean = f"{lst(cat['clean'])}[{p}]"
        if paired:
            clean = f"replace({clean}, '{{{slot}}}', {value})"
        arms.append(
            f"SELECT doc_id, '{cat['type']}' AS category, {toxic} AS toxic_text, {clean} AS clean_text FROM documents WHERE {h('42c')} % 2 = {i}"
        )
    return " UNION ALL ".join(arms)


@query(
    "synthetic_pairs",
    f"SELECT *, true AS paired FROM ({_pairs_sql(True)}) UNION ALL SELECT *, false FROM ({_pairs_sql(False)})",
)
def synthetic_pairs(s, d):
    docs = table(s, d, "documents").select("doc_id")
    a = corpus.synthetic_pairs(docs, "doc_id", PAIR_CATEGORIES, 42)
    b = corpus.synthetic_pairs(docs, "doc_id", PAIR_CATEGORIES, 42, paired=False)
    return a.withColumn("paired", F.lit(True)).unionByName(b.withColumn("paired", F.lit(False)))


_REAL_SQL = f"""SELECT doc_id, {strip_sql('text')} AS toxic_text, CASE WHEN length(t) < 3 THEN '{fv.PLAIN_SCRUB_DEFAULT}' ELSE t END AS clean_text
  FROM (SELECT doc_id, text, {simple_scrub_sql('text')} AS t FROM documents JOIN labels USING (doc_id)
    WHERE toxic = 1 AND length(text) < {fv.PLAIN_SCRUB_MAX_CHARS} AND NOT regexp_matches(text, '[\\x{{900}}-\\x{{97F}}]'))
  ORDER BY {md5_sql(42, 'doc_id')} LIMIT 300"""


def _real(s, d):
    labelled = table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels"), "doc_id")
    return corpus.real_pairs(labelled, c("toxic") == 1, 300, 42, "doc_id")


@query("real_pairs", _REAL_SQL)
def real_pairs(s, d):
    return _real(s, d)


@query(
    "curated_set",
    f"SELECT doc_id, toxic_text, clean_text, 'synthetic' AS kind FROM ({_pairs_sql(True)}) UNION ALL SELECT doc_id, toxic_text, clean_text, 'real' FROM ({_REAL_SQL})",
)
def curated_set(s, d):
    synthetic = corpus.synthetic_pairs(table(s, d, "documents").select("doc_id"), "doc_id", PAIR_CATEGORIES, 42)
    return corpus.curated_set(synthetic, _real(s, d), 42, "doc_id")


@query(
    "augment_variants",
    "SELECT item_id, i::INTEGER AS variant, CASE WHEN i = 0 THEN text ELSE text || ' [room-id:' || i || ']' END AS text FROM benchmark, range(4) r(i)",
)
def augment_variants(s, d):
    return tables.augment(table(s, d, "benchmark"), "text", 4)


# --- profile ---------------------------------------------------------------------------


def _weights_sql(cap: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS tag, p AS positives, n - p AS negatives, printf('%.2f', p::DOUBLE / n * 100)::DOUBLE AS rate_pct,
        least({cap}, greatest(1, printf('%.2f', (n - p)::DOUBLE / greatest(1, p))::DOUBLE))::DOUBLE AS weight, {cap} AS cap
        FROM (SELECT sum({t})::BIGINT AS p, count(*) AS n FROM labels)"""
        for t in ("toxic", "quality")
    )


@query("class_weights", f"{_weights_sql(25)} UNION ALL {_weights_sql(20)}")
def class_weights(s, d):
    labels = table(s, d, "labels")
    a = profile.class_weights(labels, ["toxic", "quality"]).withColumn("cap", F.lit(25))
    return a.unionByName(
        profile.class_weights(labels, ["toxic", "quality"], 20.0).withColumn("cap", F.lit(20))
    )


_LENGTHS_SQL = f"""WITH v AS (SELECT 'characters' AS unit, length(text) AS v FROM documents UNION ALL
    SELECT 'words', len({tokens_sql('text')}) FROM documents)
  SELECT unit, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5)::DOUBLE, 6) AS median, round(quantile_cont(v, 0.95)::DOUBLE, 6) AS p95, max(v)::BIGINT AS max FROM v GROUP BY unit"""


@query("length_profile", _LENGTHS_SQL)
def length_profile(s, d):
    out = profile.length_profile(documents(s, d, "text"), "text")
    return out.select("unit", *[F.round(x, 6).alias(x) for x in ("mean", "median", "p95")], "max")


@query(
    "source_mix",
    "SELECT source, count(*) AS n, printf('%.2f', count(*)::DOUBLE / sum(count(*)) OVER () * 100)::DOUBLE AS pct FROM documents GROUP BY source",
)
def source_mix(s, d):
    counts = profile.value_counts(table(s, d, "documents"), "source")
    return counts.withColumn("pct", round_exact(c("pct"), 2))


@query(
    "profile_report",
    f"""WITH x AS (SELECT d.text, d.lang, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (SELECT count(*) AS n FROM x),
    cnt AS (SELECT lang, count(*) AS c FROM x GROUP BY lang),
    w AS (SELECT 1 AS pos, 'toxic' AS tag, sum(toxic)::BIGINT AS p FROM x UNION ALL SELECT 2, 'quality', sum(quality)::BIGINT FROM x),
    v AS (SELECT 'characters' AS unit, length(text) AS v FROM x UNION ALL SELECT 'words', len({tokens_sql('text')}) FROM x)
    SELECT 0 AS section, 1 AS pos, '# Corpus profile, ' || n || ' rows' AS line FROM n
    UNION ALL SELECT 1, 1, '| source | rows | share |' UNION ALL SELECT 1, 2, '|---|---|---|'
    UNION ALL SELECT 2, row_number() OVER (ORDER BY c DESC, lang)::INTEGER, printf('| `%s` | %d | %.1f%% |', lang, c, c::DOUBLE / n.n * 100) FROM cnt, n
    UNION ALL SELECT 3, 1, '| tag | positives | negatives | rate | weight |' UNION ALL SELECT 3, 2, '|---|---|---|---|---|'
    UNION ALL SELECT 4, pos, printf('| `%s` | %d | %d | %.2f%% | %.2f |', tag, p, n.n - p, p::DOUBLE / n.n * 100, least(25.0::DOUBLE, greatest(1.0::DOUBLE, printf('%.2f', (n.n - p)::DOUBLE / greatest(1, p))::DOUBLE))) FROM w, n
    UNION ALL SELECT 5, 1, '| unit | mean | median | p95 | max |' UNION ALL SELECT 5, 2, '|---|---|---|---|---|'
    UNION ALL SELECT 6, CASE unit WHEN 'characters' THEN 1 ELSE 2 END, printf('| %s | %.1f | %.1f | %.1f | %d |', unit, avg(v), quantile_cont(v, 0.5)::DOUBLE, quantile_cont(v, 0.95)::DOUBLE, max(v)) FROM v GROUP BY unit""",
)
def profile_report(s, d):
    x = table(s, d, "documents").select("doc_id", "text", "lang").join(table(s, d, "labels"), "doc_id", "left")
    return profile.profile_lines(x.fillna(0, ["toxic", "quality"]), "text", "lang", ["toxic", "quality"])


# --- keys, inserts, users ---------------------------------------------------------------


@query(
    "insert_if_absent",
    """WITH n AS (SELECT trim(regexp_replace(lower(trim('#' || c_mktsegment)), '^#', '')) AS name, c_custkey AS id FROM customer),
    e AS (SELECT name, id FROM (VALUES ('general', -3), ('random', -2), ('building', -1)) v(name, id))
    SELECT name, id::BIGINT AS id FROM e UNION ALL SELECT name, min(id) FROM n WHERE name NOT IN (SELECT name FROM e) GROUP BY name""",
)
def insert_if_absent(s, d):
    incoming = table(s, d, "customer").select(
        T.channel_name(F.concat(F.lit("#"), c("c_mktsegment"))).alias("name"), c("c_custkey").alias("id")
    )
    existing = s.createDataFrame([("general", -3), ("random", -2), ("building", -1)], "name string, id long")
    return tables.insert_if_absent(existing, incoming, "name", "id")


@query(
    "active_sender_semi_join",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def active_sender_semi_join(s, d):
    return tables.active_only(
        table(s, d, "orders").select("o_orderkey", "o_custkey"),
        table(s, d, "customer"),
        "o_custkey",
        "c_custkey",
        c("c_acctbal") > 0,
    )


@query(
    "user_lookup",
    "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
)
def user_lookup(s, d):
    """Orders ask for their customer by an e-mail in upper case."""
    mail = lambda key: F.concat(F.lit("USER"), c(key).cast("string"), F.lit("@Example.com"))
    users = table(s, d, "customer").withColumn("email", F.lower(mail("c_custkey")))
    asked = table(s, d, "orders").select("o_orderkey", mail("o_custkey").alias("asked"))
    found = tables.find_users(asked, users, "asked", "email", c("c_acctbal") > 0)
    return found.select("o_orderkey", "c_custkey", "c_name")


@query("hashed_users", "SELECT event_id, sha256('pepper' || user_id) AS user_hash FROM events")
def hashed_users(s, d):
    return table(s, d, "events").select("event_id", monitor.hashed_id(c("user_id"), "pepper").alias("user_hash"))


# --- file sources and sinks ---------------------------------------------------------------


@query("csv_roundtrip", "SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL")
def csv_roundtrip(s, d):
    path = scratch_path(s, "csv")
    sinks.write_csv(table(s, d, "documents").select("doc_id", "lang", "source", "text"), path)
    back = readers.read_csv(s, path, "doc_id long, lang string, source string, text string", ["doc_id", "lang", "text"])
    return back.na.drop(subset=["text"])


@query(
    "jsonl_roundtrip",
    "SELECT text AS toxic_text, 'é ' || lang AS clean_text, count(*) AS n FROM documents GROUP BY ALL",
)
def jsonl_roundtrip(s, d):
    path = scratch_path(s, "pairs")
    pairs = table(s, d, "documents").select(
        c("text").alias("toxic_text"), F.concat(F.lit("é "), c("lang")).alias("clean_text")
    )
    sinks.write_jsonl(pairs, path)
    back = readers.read_jsonl(s, path)
    return back.groupBy("toxic_text", "clean_text").agg(F.count(F.lit(1)).alias("n"))


def _backup(s, d):
    return table(s, d, "documents").select(
        "text",
        F.when(c("lang") == "en", "English (comments)")
        .when(c("lang") == "fr", "hinglish")
        .when(c("lang") == "de", "hindi/hinglish (hasoc)")
        .alias("source_language"),
        *[F.lit(0).alias(t) for t in k.LABELS],
    )


@query(
    "run_metadata",
    "SELECT 'corpus' AS model, 'toxic,quality' AS tags, 3 AS epochs, toxic, n FROM (SELECT sum(toxic)::BIGINT AS toxic, count(*) AS n FROM labels)",
)
def run_metadata(s, d):
    metrics = table(s, d, "labels").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    path = scratch_path(s, "metadata")
    sinks.write_jsonl(sinks.run_metadata(metrics, "corpus", ["toxic", "quality"], 3), path)
    back = s.read.schema("model string, tags string, epochs int, metrics string").json(path)
    return back.select("model", "tags", "epochs", F.from_json("metrics", "toxic long, n long").alias("m")).select(
        "model", "tags", "epochs", "m.*"
    )


_BACKUP_SQL = "SELECT text, CASE lang WHEN 'en' THEN 'English (comments)' WHEN 'fr' THEN 'hinglish' WHEN 'de' THEN 'hindi/hinglish (hasoc)' END AS source_language, 0 AS toxic FROM documents"


@query(
    "source_fallback",
    f"""WITH b AS ({_BACKUP_SQL}) SELECT 1 AS source, text, source_language, toxic FROM b WHERE source_language ILIKE '%english%'
    UNION ALL SELECT 2, text, source_language, toxic FROM b WHERE source_language ILIKE '%hinglish%' AND NOT regexp_matches(source_language, 'curated|hasoc')
    UNION ALL SELECT 3, text, source_language, toxic FROM b WHERE regexp_matches(source_language, 'hasoc|hindi')""",
)
def source_fallback(s, d):
    backup = _backup(s, d)
    missing = scratch_path(s, "missing")

    def primary(schema):
        return lambda: readers.read_csv(s, missing, schema)

    one = readers.read_with_fallback(primary(schemas.SOURCE_COMMENTS), backup, "english")
    two = readers.read_with_fallback(primary(schemas.SOURCE_BINARY), backup, "hinglish", "curated|hasoc")
    three = readers.read_with_fallback(primary(schemas.SOURCE_CLASSED), backup, "hasoc|hindi", "curated")
    out = [
        df.select(F.lit(i).alias("source"), "text", "source_language", "toxic")
        for i, df in enumerate((one, two, three), 1)
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


SEED_ROWS = [
    ("good morning everyone", [0, 0, 0, 0, 0, 0], "english"),
    ("what a clown you are", [1, 0, 0, 0, 1, 0], "english"),
    ("नमस्ते दोस्तों", [0, 0, 0, 0, 0, 0], "hindi_devanagari"),
]


@query(
    "seed_union",
    """SELECT text, source_language, toxic, insult FROM (VALUES ('good morning everyone', 'english (curated)', 0, 0), ('what a clown you are', 'english (curated)', 1, 1),
      ('नमस्ते दोस्तों', 'hindi_devanagari (curated)', 0, 0)) v(text, source_language, toxic, insult)
    UNION ALL SELECT text, 'english (comments)', coalesce(toxic, 0), 0 FROM documents LEFT JOIN labels USING (doc_id)""",
)
def seed_union(s, d):
    docs = table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels"), "doc_id", "left")
    comments = docs.select(
        c("text").alias("comment_text"), F.coalesce("toxic", F.lit(0)).alias("toxic"), *[F.lit(0).alias(t) for t in k.LABELS if t != "toxic"]
    )
    both = readers.seed_rows(s, SEED_ROWS).unionByName(corpus.from_comments(comments))
    return both.select("text", "source_language", "toxic", "insult")


@query(
    "params_roundtrip",
    f"""WITH w AS ({_weights_sql(25)}) SELECT 'weight' AS kind, tag, weight AS value FROM w
    UNION ALL SELECT 'computed', tag, weight FROM w
    UNION ALL SELECT 'threshold', t, CASE t WHEN 'toxic' THEN round((SELECT avg(toxic) FROM labels), 4) ELSE 0.5 END FROM (VALUES {', '.join(f"('{t}')" for t in k.LABELS)}) v(t)""",
)
def params_roundtrip(s, d):
    labels = table(s, d, "labels")
    weights = profile.class_weights(labels, ["toxic", "quality"]).select("tag", "weight")
    wpath, tpath = scratch_path(s, "weights"), scratch_path(s, "thresholds")
    # Older runs with other values: 10 is newer than 9, and January newer than the December before.
    sinks.write_params(weights.withColumn("weight", c("weight") + 1), wpath, "run-9")
    sinks.write_params(weights, wpath, "run-10")
    sinks.write_params(s.createDataFrame([("toxic", 0.9), ("insult", 0.1)], schemas.THRESHOLD), tpath, "2024-12-31")
    sinks.write_params(
        labels.agg(F.round(F.avg("toxic"), 4).alias("threshold")).select(F.lit("toxic").alias("tag"), "threshold"),
        tpath,
        "2025-01-05",
    )
    stored = readers.load_weights(s, wpath, labels, ["toxic", "quality"]).select("tag", "weight")
    computed = readers.load_weights(s, scratch_path(s, "none"), labels, ["toxic", "quality"])
    thresholds = readers.load_thresholds(s, tpath)
    kinds = [("weight", stored, "weight"), ("computed", computed, "weight"), ("threshold", thresholds, "threshold")]
    parts = [df.select(F.lit(kind).alias("kind"), "tag", c(v).alias("value")) for kind, df, v in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


__all__ = ["WS_SQL"]
