"""Scoring, decision, rewrite and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark import constants as k
from modspark import fixed_values as fv
from modspark.catalog.common import (
    WORD_SQL,
    WS_SQL,
    derived_array,
    derived_scores,
    derived_sql,
    documents,
    md5_sql,
    q,
    query,
    table,
)
from modspark.catalog.texts import normalized_ctes
from modspark.functions import scores as S
from modspark.functions.maths import argmax, clamp, fixed, mean_cost, round_exact, safe_divide
from modspark.lexicon import HALF_POINT, default_lexicon
from modspark.operators import evaluate as E
from modspark.operators import policy as P
from modspark.operators import scoring, tables, training
from modspark.plans import scenarios
from modspark.plans.moderation import every_message, moderate, response_fields
from modspark.session import broadcast_if_small, scratch_path
from modspark.sources import readers, sinks

c = F.col
L = k.LABELS

_LEX_VALUES = ", ".join(
    f"({q(t)}, {', '.join(str(w) for w in ws)})" for t, ws in default_lexicon().items()
)


def _score_sql(i: int) -> str:
    p = f"coalesce(p{i}, 0)"
    return f"printf('%.4f', {p} / ({p} + {HALF_POINT})::DOUBLE)::DOUBLE AS s{i}"


def points_ctes(source: str) -> str:
    """CTEs ending in ``scored(doc_id, s0..s5)`` from a relation (doc_id, t)."""
    return f"""lex(term, {', '.join(f'w{i}' for i in range(6))}) AS (VALUES {_LEX_VALUES}),
    tok AS (SELECT doc_id, unnest(string_split_regex(t, '[^{WORD_SQL}]+')) AS term FROM {source}),
    pts AS (SELECT doc_id, {', '.join(f'sum(w{i}) AS p{i}' for i in range(6))} FROM tok JOIN lex USING (term) GROUP BY doc_id),
    scored AS (SELECT b.doc_id, {', '.join(_score_sql(i) for i in range(6))}
      FROM {source} b LEFT JOIN pts USING (doc_id))"""


def severity_sql(e: str) -> str:
    return f"CASE WHEN {e} < 0.30 THEN 'SAFE' WHEN {e} < 0.55 THEN 'LOW' WHEN {e} < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END"


def action_sql(e: str) -> str:
    return f"CASE {e} WHEN 'HIGH' THEN 'BLOCKED' WHEN 'MEDIUM' THEN 'FLAGGED' ELSE 'DELIVERED' END"


_S = [f"s{i}" for i in range(6)]
_NORM = normalized_ctes("SELECT doc_id, text AS t FROM documents")


def _normalised(s, d, *extra):
    return scoring.normalised(documents(s, d, "doc_id", "text", *extra))


@query(
    "lexicon_score",
    f"WITH {_NORM}, {points_ctes('norm')} SELECT doc_id, {', '.join(f's{i} AS {t}' for i, t in enumerate(L))} FROM scored",
)
def lexicon_score(s, d):
    scored = scoring.lexicon_scorer()(_normalised(s, d))
    return scored.select("doc_id", *[c("scores")[i].alias(t) for i, t in enumerate(L)])


@query(
    "term_table_score",
    f"WITH low AS (SELECT doc_id, lower(text) AS t FROM documents), {points_ctes('low')} "
    f"SELECT doc_id, {', '.join(f's{i} AS {t}' for i, t in enumerate(L))} FROM scored",
)
def term_table_score(s, d):
    terms = s.createDataFrame(
        [(t, tag, w) for t, ws in default_lexicon().items() for tag, w in zip(L, ws)],
        "term string, tag string, weight int",
    )
    scored = scoring.term_table_scorer(documents(s, d, "doc_id", "text"), terms, "doc_id", "text")
    return scored.select("doc_id", *[c("scores")[i].alias(t) for i, t in enumerate(L)])


# --- decisions on derived scores -----------------------------------------------------

_D = derived_sql("doc_id")
_G = "(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ((doc_id * 3301 + 11) % 10001) / 10000::DOUBLE END)"


def _scored_ids(s, d):
    return table(s, d, "documents").select("doc_id", derived_array("doc_id").alias("scores"))


@query(
    "gate_calibration",
    f"""WITH b AS (SELECT doc_id, {_G} AS g, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_D))} FROM documents),
    m AS (SELECT *, greatest({', '.join(_S)}) AS top FROM b)
    SELECT doc_id, {', '.join(f"round(CASE WHEN g < 0.40 AND top >= 0.30 THEN least(s{i}, g * 0.8) " + (f"WHEN g >= 0.60 AND top < 0.30 THEN greatest(s{i}, g) " if i == 0 else '') + f"ELSE s{i} END, 6) AS {t}" for i, t in enumerate(L))} FROM m""".replace(
        "CASE WHEN g < 0.40", "CASE WHEN g IS NULL THEN NULL WHEN g < 0.40"
    ).replace("CASE WHEN g IS NULL THEN NULL WHEN", "CASE WHEN"),
)
def gate_calibration(s, d):
    g = F.when(c("doc_id") % 5 != 0, ((c("doc_id") * 3301 + 11) % 10001) / 10000.0)
    out = _scored_ids(s, d).withColumn("gated", S.gate(c("scores"), g))
    return out.select("doc_id", *[F.round(c("gated")[i], 6).alias(t) for i, t in enumerate(L)])


@query(
    "severity_action",
    f"""WITH b AS (SELECT doc_id, greatest({', '.join(_D)}) * ((doc_id % 11) / 10::DOUBLE) AS raw FROM documents),
    o AS (SELECT doc_id, printf('%.4f', least(1, raw))::DOUBLE AS overall FROM b)
    SELECT doc_id, overall, {severity_sql('overall')} AS severity, overall >= 0.30 AS is_toxic,
      {action_sql(severity_sql('overall'))} AS status FROM o""",
)
def severity_action(s, d):
    raw = F.array_max("scores") * ((c("doc_id") % 11) / 10.0)
    out = _scored_ids(s, d).withColumn("overall", round_exact(F.least(F.lit(1.0), raw), 4))
    out = out.withColumn("severity", S.severity(c("overall")))
    return out.select(
        "doc_id", "overall", "severity", S.is_toxic(c("overall")).alias("is_toxic"), S.action(c("severity")).alias("status")
    )


_CAL = {"toxic": 0.45, "severe_toxic": 0.78, "obscene": 0.7, "threat": 0.93, "insult": 0.46}


def _triggers_sql(cuts: dict[str, float]) -> str:
    parts = ", ".join(
        f"CASE WHEN s{i} >= {cuts.get(t, 0.5)} THEN '{t.upper()} (' || printf('%.1f', s{i} * 100) || '%)' END"
        for i, t in enumerate(L)
    )
    return f"concat_ws(', ', {parts})"


@query(
    "tag_triggers",
    f"""WITH b AS (SELECT doc_id, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_D))} FROM documents),
    t AS (SELECT doc_id, {_triggers_sql(_CAL)} AS calibrated, {_triggers_sql({t: 0.15 for t in L})} AS flat FROM b)
    SELECT doc_id, calibrated, flat, calibrated <> '' AS flagged, (calibrated = '' AND flat <> '') AS only_flat FROM t""",
)
def tag_triggers(s, d):
    out = _scored_ids(s, d).select("doc_id", scenarios.compare_policies(c("scores"), _CAL).alias("p"))
    return out.select("doc_id", "p.*", (c("p.calibrated") != "").alias("flagged")).select(
        "doc_id", "calibrated", "flat", "flagged", "only_flat"
    )


@query(
    "flagged_categories_text",
    f"""WITH b AS (SELECT doc_id, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_D))} FROM documents),
    l AS (SELECT doc_id, unnest([{', '.join(f"{{'tag': '{t}', 'pos': {i}, 'score': s{i}}}" for i, t in enumerate(L))}], recursive := true) FROM b)
    SELECT b.doc_id, coalesce(string_agg(tag || ': ' || printf('%.2f', score), ', ' ORDER BY score DESC, pos) FILTER (WHERE score >= 0.3), '') AS flagged,
      count(*) FILTER (WHERE score > 0.40) AS shown_strong, count(*) FILTER (WHERE score > 0.35) AS shown FROM b JOIN l USING (doc_id) GROUP BY b.doc_id""",
)
def flagged_categories_text(s, d):
    cats = S.categories(c("scores"))
    out = _scored_ids(s, d).withColumn("cats", cats)
    return out.select(
        "doc_id",
        S.flagged_text(c("cats")).alias("flagged"),
        F.size(S.flagged_categories(c("cats"), 0.40, strict=True)).cast("long").alias("shown_strong"),
        F.size(S.flagged_categories(c("cats"), 0.35, strict=True)).cast("long").alias("shown"),
    )


@query(
    "offline_default",
    """SELECT d.doc_id, coalesce(l.v, 'fallback-offline') AS model_version, coalesce(l.score, 0) AS overall_score,
    coalesce(l.severity, 'SAFE') AS severity, coalesce(l.is_toxic, false) AS is_toxic
    FROM documents d LEFT JOIN (SELECT doc_id, 'labels' AS v, toxic::DOUBLE AS score, CASE WHEN toxic = 1 THEN 'HIGH' ELSE 'SAFE' END AS severity,
      toxic = 1 AS is_toxic FROM labels) l USING (doc_id)""",
)
def offline_default(s, d):
    results = table(s, d, "labels").select(
        "doc_id",
        F.lit("labels").alias("model_version"),
        c("toxic").cast("double").alias("overall_score"),
        F.when(c("toxic") == 1, "HIGH").otherwise("SAFE").alias("severity"),
        (c("toxic") == 1).alias("is_toxic"),
    )
    return scoring.with_offline_default(table(s, d, "documents").select("doc_id"), results, "doc_id")


@query(
    "bypass_split",
    f"""WITH m AS (SELECT conv_id * 100 + turn AS doc_id, lower(text) AS t, (role = 'system' OR turn % 3 = 0) AS skip FROM conversations),
    {points_ctes('m')}
    SELECT m.doc_id, skip AS bypassed, CASE WHEN skip THEN 0 ELSE s0 END AS toxic, {severity_sql('CASE WHEN skip THEN 0 ELSE s0 END')} AS severity
    FROM m JOIN scored USING (doc_id)""",
)
def bypass_split(s, d):
    m = table(s, d, "conversations").select(
        (c("conv_id") * 100 + c("turn")).alias("doc_id"),
        F.lower("text").alias("normalized"),
        P.bypass(c("role") == "system", F.when(c("turn") % 3 == 0, "safe_message").otherwise("message")).alias("bypassed"),
    )
    scored = scoring.lexicon_scorer()(m.filter(~c("bypassed"))).withColumn("toxic", c("scores")[0])
    safe = m.filter("bypassed").withColumn("toxic", F.lit(0.0))
    both = scored.drop("scores").unionByName(safe)
    return both.select("doc_id", "bypassed", "toxic", S.severity(c("toxic")).alias("severity"))


@query(
    "validation_quarantine",
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 50 = 1 THEN NULL ELSE text END AS text, repeat(source, 20) AS name FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL THEN 'text_missing' END, CASE WHEN text = '' THEN 'text_empty' END,
      CASE WHEN length(text) > 5000 THEN 'text_too_long' END, CASE WHEN length(name) NOT BETWEEN 2 AND 80 THEN 'name_length' END) AS violations,
      text IS NOT NULL AND text <> '' AND length(text) <= 5000 AND length(name) BETWEEN 2 AND 80 AS valid FROM b""",
)
def validation_quarantine(s, d):
    t = c("text")
    docs = table(s, d, "documents").select(
        "doc_id",
        F.when(c("doc_id") % 50 == 0, "").when(c("doc_id") % 50 != 1, t).alias("text"),
        F.repeat("source", F.lit(20)).alias("name"),
    )
    rules = {**P.request_rules(), "name_length": F.length("name").between(2, 80)}
    good, bad = P.quarantine(docs, rules)
    return good.select("doc_id", F.lit("").alias("violations"), F.lit(True).alias("valid")).unionByName(
        bad.select("doc_id", F.array_join("violations", ",").alias("violations"), F.lit(False).alias("valid"))
    )


@query(
    "policy_actions",
    f"""WITH b AS (SELECT doc_id, 'tenant' || (doc_id % 3) AS tenant, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_D))} FROM documents),
    l AS (SELECT doc_id, tenant, unnest([{', '.join(f"{{'tag': '{t}', 'score': s{i}}}" for i, t in enumerate(L))}], recursive := true) FROM b),
    p AS (SELECT 'tenant' || x.i AS tenant, y.tag, round(0.5 + x.i * 0.1 + y.o, 2) AS min_score, y.action, y.r, 'v' || x.i AS version FROM range(3) x(i)
      CROSS JOIN (VALUES ('toxic', 0.0, 'warn', 1), ('toxic', 0.25, 'review', 2), ('threat', 0.2, 'block', 3)) y(tag, o, action, r))
    SELECT doc_id, l.tenant, coalesce(arg_max(p.action, p.r) FILTER (WHERE score >= min_score), 'allow') AS action, max(version) AS policy_version
    FROM l JOIN p ON l.tenant = p.tenant AND l.tag = p.tag GROUP BY doc_id, l.tenant""",
)
def policy_actions(s, d):
    rows = []
    for i in range(3):
        for tag, offset, action in (("toxic", 0.0, "warn"), ("toxic", 0.25, "review"), ("threat", 0.2, "block")):
            rows.append((f"tenant{i}", tag, round(0.5 + i * 0.1 + offset, 2), action, f"v{i}"))
    policies = s.createDataFrame(rows, "tenant string, tag string, min_score double, action string, version string")
    long = _long_scores(s, d)
    return P.policy_actions(long, policies, "doc_id")


def _long_scores(s, d):
    tenant = F.concat(F.lit("tenant"), (c("doc_id") % 3).cast("string")).alias("tenant")
    entries = F.array(
        *[F.struct(F.lit(t).alias("tag"), e.alias("score")) for t, e in zip(L, derived_scores("doc_id"))]
    )
    return table(s, d, "documents").select("doc_id", tenant, F.inline(entries))


@query(
    "audit_log",
    f"""SELECT doc_id, {severity_sql(f'greatest({", ".join(_D)})')} AS severity, 'lexicon-1' AS model_version, 'v' || (doc_id % 3) AS policy_version FROM documents""",
)
def audit_log(s, d):
    decided = _scored_ids(s, d).select("doc_id", S.severity(F.array_max("scores")).alias("severity"))
    return P.audit_rows(decided, k.LEXICON_VERSION, F.concat(F.lit("v"), (c("doc_id") % 3).cast("string")))


@query(
    "review_queue",
    f"SELECT doc_id, round(abs({_D[0]} - 0.5), 6) AS margin FROM documents ORDER BY margin, doc_id LIMIT 50",
)
def review_queue(s, d):
    from modspark.operators.feedback import review_queue as queue

    scored = table(s, d, "documents").select("doc_id", derived_scores("doc_id")[0].alias("score"))
    return queue(scored, "score", 0.5, 50, "doc_id").select("doc_id", "margin")


# --- several models ------------------------------------------------------------------


def _logits(row_id: str, shift: int):
    return [e * 8 - 4 for e in derived_scores(row_id, shift)]


def _outputs_sql(shift: int) -> str:
    z = [f"({e} * 8 - 4)" for e in derived_sql("doc_id", shift)]
    sig = [f"1 / (1 + exp(-{x}))" for x in z]
    soft = ", ".join(f"exp({x} - m) / (exp({z[0]} - m) + exp({z[1]} - m) + exp({z[2]} - m) + exp({z[3]} - m))" for x in z[:4])
    return f"SELECT doc_id, [{sig[0]}, {', '.join(sig)}, {soft}] AS f FROM (SELECT doc_id, greatest({', '.join(z[:4])}) AS m FROM documents)"


def _outputs(s, d, shift):
    z = _logits("doc_id", shift)
    features = training.model_outputs(z[0], F.array(*z), F.array(*z[:4]))
    return documents(s, d, "doc_id").select("doc_id", features.alias("features"))


@query(
    "model_outputs",
    f"""WITH f AS ({_outputs_sql(0)}) SELECT doc_id, array_to_string(list_transform(f, lambda x: printf('%.6f', x)), ',') AS outputs,
    (list_position(f[8:11], list_max(f[8:11])) - 1)::INTEGER AS level, round(least(greatest(f[1], 0.2), 0.8), 6) AS clamped,
    round(f[1] / nullif(doc_id % 3, 0), 6) AS raw_ratio, (doc_id // greatest(doc_id % 7, 1))::BIGINT AS mean_ms FROM f""".replace(
        "round(f[1] / nullif(doc_id % 3, 0), 6)", "round(coalesce(f[1] / nullif(doc_id % 3, 0), 0), 6)"
    ),
)
def model_outputs(s, d):
    f = c("features")
    return _outputs(s, d, 0).select(
        "doc_id",
        F.array_join(F.transform(f, lambda x: F.format_string("%.6f", x)), ",").alias("outputs"),
        argmax(F.slice(f, 8, 4)).alias("level"),
        F.round(clamp(f[0], 0.2, 0.8), 6).alias("clamped"),
        F.round(safe_divide(f[0], c("doc_id") % 3), 6).alias("raw_ratio"),
        mean_cost(c("doc_id"), c("doc_id") % 7).alias("mean_ms"),
    )


@query(
    "stack_features",
    f"""WITH a AS ({_outputs_sql(0)}), b AS ({_outputs_sql(17)}), e AS ({_outputs_sql(5003)})
    SELECT doc_id, len(list_concat(a.f, b.f, e.f))::INTEGER AS width, array_to_string(list_transform(list_concat(a.f, b.f, e.f), lambda x: printf('%.6f', x)), ',') AS features
    FROM a JOIN b USING (doc_id) JOIN e USING (doc_id)""",
)
def stack_features(s, d):
    stacked = tables.stack_features([_outputs(s, d, x) for x in (0, 17, 5003)], "doc_id")
    return stacked.select(
        "doc_id",
        F.size("features").alias("width"),
        F.array_join(F.transform("features", lambda x: F.format_string("%.6f", x)), ",").alias("features"),
    )


@query("stacked_decision")
def stacked_decision(s, d):
    truth = table(s, d, "labels").select(
        "doc_id", "toxic", (c("toxic") * 2 + c("quality")).cast("int").alias("level")
    )
    stacked = training.stored(tables.stack_features([_outputs(s, d, x) for x in (0, 17, 5003)], "doc_id"), "outputs")
    meta = training.fit_meta(stacked.join(truth, "doc_id"), "toxic", "level")
    return training.decide(stacked, meta).select("doc_id", "is_toxic", "severity_level")


@query(
    "stacked_decision_checked",
    "SELECT count(*) AS rows, 33 AS width, count(*) AS decided, count(*) AS leveled FROM documents",
)
def stacked_decision_checked(s, d):
    """What holds for any stacked decision: every document once, from the outputs of three models, with a level."""
    width = tables.stack_features([_outputs(s, d, x) for x in (0, 17, 5003)], "doc_id").agg(F.max(F.size("features"))).scalar()
    out = stacked_decision(s, d).agg(
        F.count_distinct("doc_id").alias("rows"), F.count("is_toxic").alias("decided"), F.count_if(c("severity_level").between(0, 3)).alias("leveled")
    )
    return out.withColumn("width", width)


@query(
    "second_model_flag",
    f"SELECT doc_id, {_D[0]} >= 0.5 AS toxic, CASE WHEN {_D[0]} >= 0.5 THEN 'TOXIC: ' || printf('%.1f', {_D[0]} * 100) || '%' ELSE 'SAFE: ' || printf('%.1f', 100 - {_D[0]} * 100) || '%' END AS shown FROM documents",
)
def second_model_flag(s, d):
    p = derived_scores("doc_id")[0]
    both = table(s, d, "documents").select("doc_id", F.array(1 - p, p).alias("p"), p.alias("t"))
    toxic = S.binary_decision(c("p"), ["neutral", "toxic"])
    pct = lambda e: F.concat(fixed(e, 1), F.lit("%"))
    return both.select(
        "doc_id",
        toxic.alias("toxic"),
        F.when(toxic, F.concat(F.lit("TOXIC: "), pct(c("t") * 100)))
        .otherwise(F.concat(F.lit("SAFE: "), pct(100 - c("t") * 100)))
        .alias("shown"),
    )


_CHEAP = {t: [w // 2 for w in ws] for t, ws in default_lexicon().items()}
_CHEAP_VALUES = ", ".join(f"({q(t)}, {', '.join(str(w) for w in ws)})" for t, ws in _CHEAP.items())


@query(
    "cascade_scores",
    f"""WITH low AS (SELECT doc_id, lower(text) AS t FROM documents),
    {points_ctes('low')},
    clex(term, {', '.join(f'w{i}' for i in range(6))}) AS (VALUES {_CHEAP_VALUES}),
    cpts AS (SELECT doc_id, {', '.join(f'sum(w{i}) AS p{i}' for i in range(6))} FROM tok JOIN clex USING (term) GROUP BY doc_id),
    cheap AS (SELECT b.doc_id, {', '.join(_score_sql(i) for i in range(6))} FROM low b LEFT JOIN cpts USING (doc_id)),
    t AS (SELECT doc_id, greatest({', '.join('c.s%d' % i for i in range(6))}) AS ctop, greatest({', '.join('s.s%d' % i for i in range(6))}) AS stop FROM cheap c JOIN scored s USING (doc_id))
    SELECT doc_id, CASE WHEN ctop < 0.2 OR ctop >= 0.6 THEN 'cheap' ELSE 'strong' END AS stage, CASE WHEN ctop < 0.2 OR ctop >= 0.6 THEN ctop ELSE stop END AS top FROM t""",
)
def cascade_scores(s, d):
    low = documents(s, d, "doc_id", "text").select("doc_id", F.lower("text").alias("normalized"))
    out = scoring.cascade(low, scoring.lexicon_scorer(_CHEAP), scoring.lexicon_scorer(), 0.2, 0.6)
    return out.select("doc_id", "stage", F.array_max("scores").alias("top"))


@query(
    "plugin_scorer",
    "SELECT doc_id, round(least(1, length(text) / 10000::DOUBLE), 6) AS toxic FROM documents",
)
def plugin_scorer(s, d):
    """A stand-in model in Arrow batches: scores grow with the text length."""

    def load():
        return lambda texts: [[min(1.0, len(t) / 10000.0)] + [0.0] * 5 for t in texts]

    docs = documents(s, d, "doc_id", "text")
    return scoring.plugin_scorer(load, "text")(docs).select("doc_id", F.round(c("scores")[0], 6).alias("toxic"))


@query("trained_scorer")
def trained_scorer(s, d):
    docs = documents(s, d, "doc_id", "text")
    labels = table(s, d, "labels")
    features = training.featurise(docs, "text")
    weights = {"toxic": 6.0, "quality": 1.0}
    models = training.train_tags(features.join(labels, "doc_id"), ["toxic", "quality"], weights)
    scored = training.score_tags(features, models)
    return scored.select(
        "doc_id", F.round(c("scores")[0], 6).alias("toxic"), F.round(c("scores")[1], 6).alias("quality")
    )


@query("kfold_oof")
def kfold_oof(s, d):
    labelled = documents(s, d, "doc_id", "text").join(table(s, d, "labels"), "doc_id")
    features = training.featurise(tables.kfold(labelled, 3, 42, "doc_id"), "text")
    out = training.out_of_fold(features.drop("text"), 3, ["toxic"], {"toxic": 6.0})
    return out.select("doc_id", "fold", F.round(c("scores")[0], 6).alias("toxic"))


def _in_range(scored, tags, keys=()):
    long = scored.select("doc_id", *keys, F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), c(t).alias("score")) for t in tags])))
    return long, long.groupBy(*keys, "tag").agg(F.count_distinct("doc_id").alias("rows"), F.count_if(c("score").between(0, 1)).alias("in_range"))


@query("trained_scorer_checked", "SELECT tag, count(*) AS rows, count(*) AS in_range, true AS fitted FROM documents, (VALUES ('toxic'), ('quality')) v(tag) GROUP BY tag")
def trained_scorer_checked(s, d):
    """Every document has a score in range for each tag, and the models fit the rows they learned from (area under the
    curve of at least 0.9). That says nothing about rows they have not seen."""
    tags = ["toxic", "quality"]
    long, counts = _in_range(trained_scorer(s, d), tags)
    known = table(s, d, "labels").select("doc_id", F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), c(t).alias("y")) for t in tags])))
    area = E.roc_auc(long.join(known, ["doc_id", "tag"]), ["tag"], 1.0)
    return counts.join(area.select("tag", (c("roc_auc") >= 0.9).alias("fitted")), "tag")


@query(
    "kfold_oof_checked",
    f"""WITH f AS (SELECT ((row_number() OVER (ORDER BY {md5_sql(42, 'doc_id')}) - 1) % 3)::INTEGER AS fold FROM labels JOIN documents USING (doc_id))
    SELECT fold, 'toxic' AS tag, count(*) AS rows, count(*) AS in_range FROM f GROUP BY fold""",
)
def kfold_oof_checked(s, d):
    """Every labelled row is scored once, in its fold and in range. No held-out quality is claimed: on these tables
    words do not tell the label (area under the curve 0.52 over the 399 labelled rows of sf0.01)."""
    return _in_range(kfold_oof(s, d), ["toxic"], ["fold"])[1]


# --- rewrites ------------------------------------------------------------------------


def _scrub_ctes(source: str) -> str:
    """CTEs ending in ``scrubbed(doc_id, text, t)`` with the default rules."""
    e = "text"
    w = f"[^{WORD_SQL}]"
    for words, repl, whole in fv.SCRUB_RULES:
        if whole:
            once = rf"regexp_replace({{e}}, '(?i)(^|{w})(?:{words})($|{w})', '\1{repl}\2', 'g')"
            e = once.replace("{e}", once.replace("{e}", e))
        else:
            e = f"regexp_replace({e}, '{words}', '{repl}', 'g')"
    return f"""r0 AS (SELECT doc_id, text, trim(regexp_replace({e}, '[{WS_SQL}]+', ' ', 'g'), ' ') AS t FROM {source}),
    r1 AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, ' , *', ', ', 'g'), '^ *, *', '') AS t FROM r0),
    scrubbed AS (SELECT doc_id, text, CASE WHEN length(t) > 2 THEN upper(t[1]) || t[2:] ELSE text END AS t FROM r1)"""


_REPLY = "CASE lang " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.REPLY_TEMPLATES.items()) + f" ELSE {q(fv.REPLY_TEMPLATES['en'])} END"


@query(
    "rewrite_router",
    f"""WITH {_scrub_ctes('documents')}, x AS (SELECT s.doc_id, s.text AS original, s.t, d.lang,
      CASE s.doc_id % 4 WHEN 0 THEN 'Please be polite.' WHEN 1 THEN 'calm ' || d.source WHEN 2 THEN '' END AS answer FROM scrubbed s JOIN documents d USING (doc_id))
    SELECT doc_id, original, CASE WHEN doc_id % 4 = 1 THEN answer ELSE t END AS detoxified, CASE WHEN doc_id % 4 = 1 THEN 'external' ELSE 'intent_preserving_scrubber' END AS method,
      CASE WHEN doc_id % 4 = 1 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence, {_REPLY} AS template_reply,
      CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'latin' END AS route FROM x""",
)
def rewrite_router(s, d):
    docs = documents(s, d, "doc_id", "text", "lang", "source").withColumnRenamed("lang", "language")
    which = c("doc_id") % 4
    answers = table(s, d, "documents").select(
        "doc_id",
        F.when(which == 0, "Please be polite.")
        .when(which == 1, F.concat(F.lit('"calm '), c("source"), F.lit('"')))
        .when(which == 2, "")
        .alias("rewrite"),
    )
    out = P.rewrites(docs, "doc_id", answers)
    from modspark.functions import lang as LG
    from modspark.functions.text import reply_template

    return out.select(
        "doc_id",
        "original",
        "detoxified",
        "method",
        "confidence",
        reply_template(c("language")).alias("template_reply"),
        S.route(c("doc_id") % 2 != 0, LG.has_devanagari(c("text"))).alias("route"),
    )


@query(
    "accepted_suggestions",
    """WITH m AS (SELECT conv_id, turn, conv_id || '-' || turn AS message_id, text AS content, CASE WHEN turn % 2 = 0 THEN 'FLAGGED' ELSE 'DELIVERED' END AS status,
      turn % 2 = 0 AS is_toxic, CASE WHEN turn % 2 = 0 THEN 'MEDIUM' ELSE 'SAFE' END AS severity, turn % 4 = 0 AS took FROM conversations)
    SELECT message_id, CASE WHEN took THEN 'calm ' || content ELSE content END AS content, CASE WHEN took THEN 'DELIVERED' ELSE status END AS status,
      is_toxic AND NOT took AS is_toxic, CASE WHEN took THEN 'SAFE' ELSE severity END AS severity FROM m""",
)
def accepted_suggestions(s, d):
    even = c("turn") % 2 == 0
    messages = table(s, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        c("text").alias("content"),
        F.when(even, "FLAGGED").otherwise("DELIVERED").alias("status"),
        even.alias("is_toxic"),
        F.when(even, "MEDIUM").otherwise("SAFE").alias("severity"),
        "turn",
    )
    accepted = messages.filter(c("turn") % 4 == 0).select(
        "message_id", F.concat(F.lit("calm "), c("content")).alias("suggestion")
    )
    return P.accept_suggestions(messages.drop("turn"), accepted)


# --- scenarios and end to end ----------------------------------------------------------


@query(
    "scenario_report",
    f"""WITH low AS (SELECT doc_id, lower(text) AS t FROM documents), {points_ctes('low')},
    r AS (SELECT doc_id, source AS category, greatest({', '.join('s.' + x for x in _S)}) >= 0.3 AS flagged,
      concat_ws(', ', {', '.join(f"CASE WHEN s{i} >= 0.5 THEN '{t.upper()}(' || printf('%.0f', s{i} * 100) || '%)' END" for i, t in enumerate(L))}) AS detected_tags,
      CASE greatest({', '.join(_S)}) {' '.join(f"WHEN s{i} THEN '{t.upper()}'" for i, t in enumerate(L))} END || ': ' || printf('%.1f', greatest({', '.join(_S)}) * 100) || '%' AS top_score
      FROM scored s JOIN documents USING (doc_id))
    SELECT 'result' AS part, category, doc_id, flagged, detected_tags, top_score, 1::BIGINT AS total, flagged::BIGINT AS toxic, (NOT flagged)::BIGINT AS safe FROM r
    UNION ALL SELECT 'summary', category, NULL, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE flagged), count(*) FILTER (WHERE NOT flagged) FROM r GROUP BY category""",
)
def scenario_report(s, d):
    low = documents(s, d, "doc_id", "source", "text").select(
        "doc_id", c("source").alias("category"), F.lower("text").alias("normalized")
    )
    results = scenarios.scenario_results(scoring.lexicon_scorer()(low)).select(
        F.lit("result").alias("part"),
        "category", "doc_id", "flagged", "detected_tags", "top_score",
        F.lit(1).cast("long").alias("total"),
        c("flagged").cast("long").alias("toxic"),
        (~c("flagged")).cast("long").alias("safe"),
    )
    head = scenarios.summary(results.select("category", "flagged"), ("category",))
    return results.unionByName(
        head.withColumn("part", F.lit("summary")), allowMissingColumns=True
    )


@query(
    "report_document",
    f"""WITH low AS (SELECT doc_id, lower(text) AS t FROM documents), {points_ctes('low')}, r AS (SELECT doc_id, source AS category, greatest({', '.join(_S)}) >= 0.3 AS flagged FROM scored JOIN documents USING (doc_id))
    SELECT 'result' AS part, doc_id, category, flagged, NULL::BIGINT AS total, NULL::BIGINT AS toxic, NULL::BIGINT AS safe FROM r
    UNION ALL SELECT 'summary', NULL, NULL, NULL, count(*), count(*) FILTER (WHERE flagged), count(*) FILTER (WHERE NOT flagged) FROM r""",
)
def report_document(s, d):
    """The report written as one document and read back."""
    low = documents(s, d, "doc_id", "source", "text").select("doc_id", c("source").alias("category"), F.lower("text").alias("normalized"))
    results = scenarios.scenario_results(scoring.lexicon_scorer()(low)).select("doc_id", "category", "flagged")
    head = scenarios.summary(results)
    path = scratch_path(s, "report")
    sinks.write_lines(sinks.report_document(results, head, "doc_id"), path, ["part", "pos"])
    rows, total = readers.read_report(s, path, results.schema, head.schema)
    return rows.withColumn("part", F.lit("result")).unionByName(total.withColumn("part", F.lit("summary")), allowMissingColumns=True)


@query(
    "batch_requests",
    f"""WITH m AS (SELECT conv_id * 100 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS doc_id, conv_id, lower(text) AS t FROM conversations), {points_ctes('m')}
    SELECT conv_id, (m.doc_id % 100)::INTEGER AS position, s0 AS toxic, {severity_sql('s0')} AS severity, NULL AS reason FROM m JOIN scored USING (doc_id)
      WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <= {k.BATCH_MAX})
    UNION ALL SELECT conv_id, NULL, NULL, NULL, 'batch_size' FROM conversations GROUP BY conv_id HAVING count(*) > {k.BATCH_MAX}""",
)
def batch_requests(s, d):
    """Conversations as array requests. Sizes are counted first, so only turns of requests that are small
    enough are gathered; the others come out with a reason."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    given = table(s, d, "conversations")
    sizes = given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    too_large = broadcast_if_small(sizes.filter(c("n") > k.BATCH_MAX).select("conv_id"))
    requests = given.join(too_large, "conv_id", "left_anti").groupBy("conv_id").agg(
        F.transform(turns, lambda e: e["text"]).alias("texts")
    )
    valid, _ = P.quarantine(requests, P.batch_rules())
    rows = tables.batch_messages(valid).withColumn("normalized", F.lower("text"))
    scored = scoring.lexicon_scorer()(rows).withColumn("toxic", c("scores")[0])
    done = scored.select("conv_id", "position", "toxic", S.severity(c("toxic")).alias("severity"))
    return done.unionByName(too_large.withColumn("reason", F.lit("batch_size")), allowMissingColumns=True)


_TOP = f"greatest({', '.join(_S)})"


@query(
    "two_model_report",
    f"""WITH low AS (SELECT doc_id, lower(text) AS t FROM documents), {points_ctes('low')},
    a AS (SELECT doc_id, {_triggers_sql({t: 0.5 for t in L})} AS tags, {_TOP} AS top FROM scored),
    b AS (SELECT doc_id, {_D[0]} AS p FROM documents),
    r AS (SELECT doc_id, CASE WHEN tags <> '' THEN tags ELSE 'SAFE' END AS x, CASE WHEN p >= 0.5 THEN 'TOXIC(' || printf('%.0f', p * 100) || '%)' ELSE 'SAFE' END AS y,
      tags <> '' AS fx, p >= 0.5 AS fy FROM a JOIN b USING (doc_id))
    SELECT doc_id, CASE WHEN length(x) > 32 THEN substr(x, 1, 29) || '...' ELSE x END AS first_prediction, y AS second_prediction, fx AS first_flagged, fy AS second_flagged, 1::BIGINT AS total, fx::BIGINT AS first_toxic, fy::BIGINT AS second_toxic FROM r
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE fx), count(*) FILTER (WHERE fy) FROM r""",
)
def two_model_report(s, d):
    low = documents(s, d, "doc_id", "text").select("doc_id", F.lower("text").alias("normalized"))
    tags = F.array_join(S.tag_triggers(c("scores"), 0.5), ", ")
    first = scoring.lexicon_scorer()(low).select("doc_id", tags.alias("tags")).select(
        "doc_id",
        F.when(c("tags") != "", c("tags")).otherwise("SAFE").alias("shown"),
        (c("tags") != "").alias("flagged"),
    )
    p = derived_scores("doc_id")[0]
    second = table(s, d, "documents").select(
        "doc_id",
        F.when(p >= 0.5, F.concat(F.lit("TOXIC("), fixed(p * 100, 0), F.lit("%)"))).otherwise("SAFE").alias("shown"),
        S.binary_decision(F.array(1 - p, p), ["neutral", "toxic"]).alias("flagged"),
    )
    rows = scenarios.two_model_rows(first, second, "doc_id")
    counted = rows.select(
        "*",
        F.lit(1).cast("long").alias("total"),
        c("first_flagged").cast("long").alias("first_toxic"),
        c("second_flagged").cast("long").alias("second_toxic"),
    )
    return counted.unionByName(scenarios.two_model_summary(rows), allowMissingColumns=True)


_LIMIT = (20, 60)
_E2E = f"""WITH v AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS user_id, doc_id - doc_id % 2 AS sec FROM documents),
  rl AS (SELECT *, coalesce(count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 59 PRECEDING AND 1 PRECEDING), 0)
     + row_number() OVER (PARTITION BY user_id, sec ORDER BY doc_id) - 1 AS prior FROM v),
  ok AS (SELECT *, doc_id % 20 = 0 AS skip FROM rl WHERE prior < 20 AND length(text) BETWEEN 1 AND {k.TEXT_MAX}),
  {normalized_ctes("SELECT doc_id, CASE WHEN skip THEN '' ELSE text END AS t FROM ok")}, {points_ctes('norm')},
  {_scrub_ctes('ok')},
  o AS (SELECT doc_id, greatest({', '.join(_S)}) AS overall FROM scored),
  w AS (SELECT ok.doc_id, CASE WHEN skip THEN 'en' ELSE lang END AS detected_language, overall, {severity_sql('overall')} AS severity, scrubbed.t AS rewritten, skip
    FROM ok JOIN o USING (doc_id) JOIN scrubbed USING (doc_id)),
  every AS (SELECT w.doc_id, detected_language, overall AS score, severity, overall >= 0.3 AS toxic, {action_sql('severity')} AS status, '' AS reason,
    CASE WHEN severity IN ('MEDIUM', 'HIGH') THEN rewritten END AS rewrite, CASE WHEN skip THEN 'bypass' ELSE 'lexicon-1' END AS model_version FROM w
  UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'RATE_LIMITED', 'rate_limit', NULL, NULL FROM rl WHERE prior >= 20
  UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'INVALID', CASE WHEN text IS NULL THEN 'text_missing' WHEN length(text) < 1 THEN 'text_empty' ELSE 'text_too_long' END, NULL, NULL
    FROM rl WHERE prior < 20 AND NOT coalesce(length(text) BETWEEN 1 AND {k.TEXT_MAX}, false))
  SELECT every.*, l.toxic AS label_toxic FROM every LEFT JOIN labels l USING (doc_id)"""


def moderated_documents(s, d):
    docs = documents(s, d, "doc_id", "text", "lang").withColumns(
        {
            # user 0 sends a third of all messages and runs into the limit
            "user_id": F.when(c("doc_id") % 3 == 0, 0).otherwise(c("doc_id") % 50),
            "second": c("doc_id") - c("doc_id") % 2,
            "arrival": c("doc_id"),
        }
    )
    return moderate(
        docs,
        row_id="doc_id",
        limits=_LIMIT,
        skip=c("doc_id") % 20 == 0,
        fallback_language=c("lang"),
    )


@query("moderate_end_to_end", _E2E)
def moderate_end_to_end(s, d):
    labels = table(s, d, "labels").select("doc_id", c("toxic").alias("label_toxic"))
    out = response_fields(every_message(moderated_documents(s, d))).join(labels, "doc_id", "left")
    reason = F.array_join("reasons", ",").alias("reason")
    return out.select(
        "doc_id", "detected_language", "score", "severity", "toxic", "status", reason, "rewrite", "model_version", "label_toxic"
    )
