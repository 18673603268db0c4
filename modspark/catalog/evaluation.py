"""Metrics, thresholds and model comparisons on lexicon and derived scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark import constants as k
from modspark.catalog.common import clean_sql, derived_scores, derived_sql, documents, query, table
from modspark.catalog.flows import context_sql
from modspark.catalog.moderation import points_ctes
from modspark.catalog.texts import RULES_SQL, normalized_ctes
from modspark.functions import lang as L
from modspark.functions import scores as S
from modspark.functions import text as T
from modspark.functions.maths import focal
from modspark.operators import evaluate as E
from modspark.operators import scoring, tables
from modspark.plans.moderation import moderate_conversations

c = F.col

# Tags with their truth and their position in the score array.
TAGS = {"toxic": ("toxic", 0), "insult": ("toxic", 4), "obscene": ("1 - quality", 2)}
_SPLIT_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END"


def _labelled(s, d):
    docs = documents(s, d, "doc_id", "lang", "text").join(table(s, d, "labels"), "doc_id")
    return docs.withColumn("split", F.when(c("doc_id") % 2 == 0, "val").otherwise("test"))


def _truth():
    return {"toxic": c("toxic"), "insult": c("toxic"), "obscene": 1 - c("quality")}


def predictions(s, d):
    """Long table of the lexicon model: doc_id, lang, split, tag, y, score."""
    scored = scoring.lexicon_scorer()(_labelled(s, d).withColumn("normalized", F.lower("text")))
    scores = {t: c("scores")[i] for t, (_, i) in TAGS.items()}
    return E.to_long(scored, "doc_id", scores, _truth(), ["lang", "split"])


def derived_predictions(s, d):
    """Long table of a second model with derived scores."""
    e = derived_scores("doc_id")
    labels = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id")
    labels = labels.withColumn("split", F.when(c("doc_id") % 2 == 0, "val").otherwise("test"))
    return E.to_long(labels, "doc_id", {t: e[i] for t, (_, i) in TAGS.items()}, _truth(), ["lang", "split"])


_LOW = f"low AS (SELECT doc_id, lower(text) AS t FROM documents JOIN labels USING (doc_id)), {points_ctes('low')}"
_PRED = _LOW + ", pred AS (" + " UNION ALL ".join(
    f"SELECT doc_id, lang, {_SPLIT_SQL} AS split, '{t}' AS tag, {truth} AS y, s{i} AS score FROM scored JOIN labels USING (doc_id) JOIN documents USING (doc_id)"
    for t, (truth, i) in TAGS.items()
) + ")"
_DPRED = "dpred AS (" + " UNION ALL ".join(
    f"SELECT doc_id, lang, {_SPLIT_SQL} AS split, '{t}' AS tag, {truth} AS y, {derived_sql('doc_id')[i]} AS score FROM labels JOIN documents USING (doc_id)"
    for t, (truth, i) in TAGS.items()
) + ")"


def confusion_sql(source: str, keys: str, hit: str = "score >= 0.5") -> str:
    return f"""SELECT {keys}, count(*) FILTER (WHERE {hit} AND y = 1) AS tp, count(*) FILTER (WHERE {hit} AND y = 0) AS fp,
      count(*) FILTER (WHERE NOT ({hit}) AND y = 1) AS fn, count(*) FILTER (WHERE NOT ({hit}) AND y = 0) AS tn FROM {source} GROUP BY {keys}"""


def f1_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return f"coalesce(2 * {tp}::DOUBLE / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"


_F1 = f1_sql()


@query(
    "per_tag_prf",
    f"""WITH {_PRED}, n AS ({confusion_sql('pred', 'tag')}) SELECT tag, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1 FROM n""",
)
def per_tag_prf(s, d):
    out = E.confusion(predictions(s, d))
    return out.select("tag", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(
    "macro_micro_f1",
    f"""WITH {_PRED}, n AS ({confusion_sql('pred', 'split, tag')}) SELECT split, round(avg({_F1}), 6) AS macro_f1,
      round({f1_sql('sum(tp)', 'sum(fp)', 'sum(fn)')}, 6) AS micro_f1 FROM n GROUP BY split""",
)
def macro_micro_f1(s, d):
    out = E.macro_micro(E.confusion(predictions(s, d), ["split", "tag"]), ["split"])
    return out.select("split", F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


# Average rank of every score within its tag gives the rank-sum area.
_AUC = """SELECT {keys}, CASE WHEN sum(y) = 0 OR sum(1 - y) = 0 THEN NULL ELSE
    (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE END AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2::DOUBLE AS r FROM {source}) GROUP BY {keys}"""


@query(
    "roc_auc",
    f"WITH {_PRED}, {_DPRED}, a AS ({_AUC.format(keys='tag', source='pred')}), b AS ({_AUC.format(keys='tag', source='dpred')}) "
    "SELECT 'lexicon' AS model, tag, round(auc, 6) AS roc_auc FROM a UNION ALL SELECT 'derived', tag, round(auc, 6) FROM b",
)
def roc_auc(s, d):
    a = E.roc_auc(predictions(s, d)).withColumn("model", F.lit("lexicon"))
    b = E.roc_auc(derived_predictions(s, d)).withColumn("model", F.lit("derived"))
    return a.unionByName(b).select("model", "tag", F.round("roc_auc", 6).alias("roc_auc"))


def _curve_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, score, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS pp, sum(pos) OVER (PARTITION BY {keys}) AS p
      FROM (SELECT {keys}, score, sum(y) AS pos, count(*) AS n FROM {source} GROUP BY {keys}, score) WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)"""


@query(
    "pr_auc",
    f"""WITH {_PRED}, {_DPRED}, a AS ({_curve_sql('pred', 'tag')}), b AS ({_curve_sql('dpred', 'tag')})
    SELECT 'lexicon' AS model, tag, round(sum(pos::DOUBLE / p * (tp::DOUBLE / pp)), 6) AS pr_auc FROM a GROUP BY tag
    UNION ALL SELECT 'derived', tag, round(sum(pos::DOUBLE / p * (tp::DOUBLE / pp)), 6) FROM b GROUP BY tag""",
)
def pr_auc(s, d):
    a = E.pr_auc(predictions(s, d)).withColumn("model", F.lit("lexicon"))
    b = E.pr_auc(derived_predictions(s, d)).withColumn("model", F.lit("derived"))
    return a.unionByName(b).select("model", "tag", F.round("pr_auc", 6).alias("pr_auc"))


@query(
    "recall_at_precision",
    f"""WITH {_PRED}, a AS ({_curve_sql('pred', 'tag')}) SELECT tag, round(coalesce(max(tp::DOUBLE / p) FILTER (WHERE tp::DOUBLE / pp >= 0.5), 0), 6) AS recall FROM a GROUP BY tag""",
)
def recall_at_precision(s, d):
    return E.recall_at_precision(predictions(s, d), 0.5).select("tag", F.round("recall", 6).alias("recall"))


def _best_sql(source: str) -> str:
    """Best threshold per tag on the val split: largest F1, then lowest score."""
    return f"""SELECT tag, p AS positives, score AS threshold, 2 * tp::DOUBLE / (pp + p) AS f1 FROM ({_curve_sql("(SELECT * FROM " + source + " WHERE split = 'val')", 'tag')})
      QUALIFY row_number() OVER (PARTITION BY tag ORDER BY 2 * tp::DOUBLE / (pp + p) DESC, score) = 1"""


@query(
    "optimal_threshold",
    f"""WITH {_DPRED}, b AS ({_best_sql('dpred')}), n AS ({confusion_sql("(SELECT * FROM dpred WHERE split = 'val')", 'tag')})
    SELECT tag, positives::BIGINT AS positives, round(threshold, 6) AS threshold, printf('%.4f', threshold)::DOUBLE AS threshold_rounded,
      round(b.f1, 6) AS f1_best, round({_F1}, 6) AS f1_default FROM b JOIN n USING (tag)""",
)
def optimal_threshold(s, d):
    out = E.optimal_thresholds(derived_predictions(s, d).filter("split = 'val'"))
    return out.select(
        "tag", "positives", F.round("threshold", 6).alias("threshold"), "threshold_rounded",
        F.round("f1_best", 6).alias("f1_best"), F.round("f1_default", 6).alias("f1_default"),
    )


def _policies_sql(keys: str) -> str:
    return f"""b AS ({_best_sql('dpred')}), j AS (SELECT dpred.*, b.threshold FROM dpred JOIN b USING (tag)),
    pol AS (SELECT 'static' AS policy, * FROM ({confusion_sql('j', keys)}) UNION ALL SELECT 'tuned', * FROM ({confusion_sql('j', keys, 'score >= threshold')}))"""


@query(
    "threshold_gain",
    f"""WITH {_DPRED}, {_policies_sql('split, tag')},
    m AS (SELECT split, policy, avg({_F1}) AS macro_f1, {f1_sql('sum(tp)', 'sum(fp)', 'sum(fn)')} AS micro_f1 FROM pol GROUP BY split, policy),
    l AS (SELECT split, policy, 'macro_f1' AS metric, macro_f1 AS v FROM m UNION ALL SELECT split, policy, 'micro_f1', micro_f1 FROM m),
    w AS (SELECT split, metric, max(v) FILTER (WHERE policy = 'static') AS st, max(v) FILTER (WHERE policy = 'tuned') AS tu FROM l GROUP BY split, metric)
    SELECT split, metric, round(st, 6) AS static, round(tu, 6) AS tuned, round(tu - st, 6) AS gain FROM w""",
)
def threshold_gain(s, d):
    long = E.count_scores(derived_predictions(s, d), ["split", "tag"])
    best = E.thresholds_of_split(long, "val")
    out = E.threshold_gain(long, best)
    return out.select("split", "metric", *[F.round(x, 6).alias(x) for x in ("static", "tuned", "gain")])


@query(
    "tag_breakdown",
    f"""WITH {_DPRED}, {_policies_sql('tag')}, w AS (SELECT tag, max(tp + fn) AS positives, max({_F1}) FILTER (WHERE policy = 'static') AS st, max({_F1}) FILTER (WHERE policy = 'tuned') AS tu FROM pol GROUP BY tag)
    SELECT tag, positives, round(st, 6) AS f1_static, round(tu, 6) AS f1_tuned, round(tu - st, 6) AS gain FROM w""",
)
def tag_breakdown(s, d):
    long = E.count_scores(derived_predictions(s, d), ["split", "tag"])
    best = E.thresholds_of_split(long, "val")
    out = E.tag_breakdown(long, best)
    return out.select("tag", "positives", *[F.round(x, 6).alias(x) for x in ("f1_static", "f1_tuned", "gain")])


_W = {"toxic": 6.82, "insult": 6.82, "obscene": 5.0}
_LOGIT = "(score * 8 - 4)"
_SOFT = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_WSQL = "CASE tag " + " ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, w in _W.items()) + " END"
_BCE = f"({_WSQL} * y * {_SOFT.format(x='-' + _LOGIT)} + (1 - y) * {_SOFT.format(x=_LOGIT)})"


def _loss():
    return E.weighted_loss(None, _W, c("score") * 8 - 4)


@query("weighted_bce", f"WITH {_DPRED} SELECT tag, round(avg({_BCE}), 6) AS loss FROM dpred GROUP BY tag")
def weighted_bce(s, d):
    return derived_predictions(s, d).groupBy("tag").agg(F.round(F.avg(_loss()), 6).alias("loss"))


@query("focal_loss", f"WITH {_DPRED} SELECT tag, round(avg(pow(1 - exp(-{_BCE}), 2) * {_BCE}), 6) AS loss FROM dpred GROUP BY tag")
def focal_loss(s, d):
    return derived_predictions(s, d).groupBy("tag").agg(F.round(F.avg(focal(_loss())), 6).alias("loss"))


def _eval_sql(source: str, model: str) -> str:
    return f"""SELECT '{model}' AS model, split, l.rows, l.loss, m.macro_f1, m.micro_f1, a.auc AS roc_auc FROM
      (SELECT split, count(*) // 3 AS rows, avg({_BCE}) AS loss FROM {source} GROUP BY split) l
      JOIN (SELECT split, avg({_F1}) AS macro_f1, {f1_sql('sum(tp)', 'sum(fp)', 'sum(fn)')} AS micro_f1 FROM ({confusion_sql(source, 'split, tag')}) GROUP BY split) m USING (split)
      JOIN (SELECT split, avg(auc) AS auc FROM ({_AUC.format(keys='split, tag', source=source)}) GROUP BY split) a USING (split)"""


_EVAL = f"ev AS ({_eval_sql('pred', 'lexicon')} UNION ALL {_eval_sql('dpred', 'derived')})"


def _evaluated(s, d):
    a = E.evaluate(predictions(s, d), _loss(), ["split"], len(TAGS)).withColumn("model", F.lit("lexicon"))
    b = E.evaluate(derived_predictions(s, d), _loss(), ["split"], len(TAGS)).withColumn("model", F.lit("derived"))
    return a.unionByName(b)


@query(
    "eval_per_split",
    f"""WITH {_PRED}, {_DPRED}, {_EVAL} SELECT model, split, rows::BIGINT AS rows, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity,
      round(macro_f1, 6) AS macro_f1, round(micro_f1, 6) AS micro_f1, round(roc_auc, 6) AS roc_auc FROM ev""",
)
def eval_per_split(s, d):
    out = _evaluated(s, d)
    return out.select(
        "model", "split", "rows",
        *[F.round(x, 6).alias(x) for x in ("loss", "perplexity", "macro_f1", "micro_f1", "roc_auc")],
    )


@query(
    "model_comparison",
    f"""WITH {_PRED}, {_DPRED}, {_EVAL}, l AS (SELECT split, model, unnest([{{'metric': 'loss', 'v': loss}}, {{'metric': 'macro_f1', 'v': macro_f1}}, {{'metric': 'micro_f1', 'v': micro_f1}}], recursive := true) FROM ev)
    SELECT split, metric, round(max(v) FILTER (WHERE model = 'derived'), 6) AS base, round(max(v) FILTER (WHERE model = 'lexicon'), 6) AS tuned,
      round(max(v) FILTER (WHERE model = 'lexicon') - max(v) FILTER (WHERE model = 'derived'), 6) AS difference FROM l GROUP BY split, metric""",
)
def model_comparison(s, d):
    out = E.compare_models(_evaluated(s, d), "derived", "lexicon", ["loss", "macro_f1", "micro_f1"])
    return out.select("split", "metric", *[F.round(x, 6).alias(x) for x in ("base", "tuned", "difference")])


def _line(e: str) -> str:
    return f"printf('%.4f', {e})"


@query(
    "comparison_report",
    f"""WITH {_PRED}, {_DPRED}, {_EVAL}, l AS (SELECT split, model, unnest([{{'metric': 'macro_f1', 'v': macro_f1}}, {{'metric': 'micro_f1', 'v': micro_f1}}], recursive := true) FROM ev),
    w AS (SELECT split, metric, max(v) FILTER (WHERE model = 'derived') AS b, max(v) FILTER (WHERE model = 'lexicon') AS t FROM l GROUP BY split, metric)
    SELECT split, metric, '| ' || split || ' | ' || metric || ' | ' || {_line('b')} || ' | ' || {_line('t')} || ' | ' || CASE WHEN t - b < 0 THEN '-' ELSE '+' END || {_line('abs(t - b)')} || ' |' AS line FROM w""",
)
def comparison_report(s, d):
    return E.comparison_lines(E.compare_models(_evaluated(s, d), "derived", "lexicon", ["macro_f1", "micro_f1"]))


@query(
    "aligned_predictions",
    f"""WITH {_LOW}, b AS (SELECT doc_id, {derived_sql('doc_id')[0]} AS score FROM documents)
    SELECT doc_id, a.s0 AS a_score, b.score AS b_score, (a.s0 >= 0.5) IS DISTINCT FROM (b.score >= 0.5) AS differ FROM scored a FULL JOIN b USING (doc_id)""",
)
def aligned_predictions(s, d):
    a = predictions(s, d).filter("tag = 'toxic'").select("doc_id", "score")
    b = table(s, d, "documents").select("doc_id", derived_scores("doc_id")[0].alias("score"))
    out = tables.align_predictions(a, b, "doc_id")
    differ = ~(c("a_score") >= 0.5).eqNullSafe(c("b_score") >= 0.5)
    return out.withColumn("differ", differ)


# Conversations, some in two scripts or with look-alikes, scored with and without what was said before.
_SPOKEN_SQL = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN translate(text, 'aeiou', 'अएइओउ') WHEN 2 THEN replace(text, 'o', '0') || '!!!!'
  WHEN 3 THEN text || ' kya hai' ELSE text END AS text FROM conversations"""
_KINDS = ("language", "script", "obfuscated", "context")
_SLICES_SQL = f"""v AS ({_SPOKEN_SQL}), f AS (SELECT *, conv_id * 1000 + turn AS doc_id, regexp_matches(text, '[\\x{{900}}-\\x{{D7F}}]') AS indic, regexp_matches(text, '[a-zA-Z]') AS latin FROM v),
    r AS (SELECT l.language, CASE WHEN indic AND latin THEN 'mixed' WHEN indic THEN 'indic' WHEN latin THEN 'latin' ELSE 'none' END AS script,
      n.t <> {clean_sql('f.text')} AS obfuscated, f.turn > min(f.turn) OVER (PARTITION BY f.conv_id) AS context, coalesce(y.toxic, 0) AS y, a.overall, a.alone
      FROM f JOIN ({context_sql('v')}) a USING (conv_id, turn) JOIN (WITH s AS (SELECT doc_id, 'en' AS lang, text AS t FROM f), {RULES_SQL}) l USING (doc_id)
      JOIN (WITH {normalized_ctes('SELECT doc_id, text AS t FROM f')} SELECT doc_id, t FROM norm) n USING (doc_id) LEFT JOIN labels y ON y.doc_id = f.conv_id),
    p AS (SELECT *, 'candidate' AS model, overall AS score FROM r UNION ALL SELECT *, 'champion', alone FROM r),
    c AS ({' UNION ALL '.join(f"SELECT '{kind}' AS kind, * FROM ({confusion_sql(f'(SELECT {kind}::VARCHAR AS slice, * FROM p)', 'slice, model')})" for kind in _KINDS)})"""


def _sliced(s, d):
    """Counts per slice of the scorer with context (candidate) and without (champion), from one scan and one exchange."""
    t, which = c("text"), c("conv_id") % 4
    spoken = F.when(which == 1, F.translate(t, "aeiou", "अएइओउ")).when(which == 2, F.concat(F.replace(t, F.lit("o"), F.lit("0")), F.lit("!!!!")))
    said = table(s, d, "conversations").select("conv_id", "turn", spoken.when(which == 3, F.concat(t, F.lit(" kya hai"))).otherwise(t).alias("text"))
    scored = moderate_conversations(said, "conv_id", "turn")
    indic, latin = t.rlike(L.ANY_INDIAN), t.rlike("[a-zA-Z]")
    truth = table(s, d, "labels").select(c("doc_id").alias("conv_id"), "toxic")
    rows = scored.join(truth, "conv_id", "left").select(
        c("detected_language").alias("language"),
        F.when(indic & latin, "mixed").when(indic, "indic").when(latin, "latin").otherwise("none").alias("script"),
        (T.normalize_for_toxicity(t) != T.clean_text(t)).alias("obfuscated"),
        (F.size("history") > 0).alias("context"),
        F.coalesce("toxic", F.lit(0)).alias("y"),
        F.inline(F.array(*[
            F.struct(F.lit(model).alias("model"), score.alias("score"))
            for model, score in (("candidate", c("overall_score")), ("champion", F.array_max(S.lexicon_scores(T.normalize_for_toxicity(t)))))
        ])),
    )
    return E.slice_confusion(rows, _KINDS, ["model"])


@query(
    "slice_metrics",
    f"""WITH {_PRED}, n AS ({confusion_sql('pred', 'lang, tag')}) SELECT lang AS slice, tag, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1 FROM n""",
)
def slice_metrics(s, d):
    out = E.slice_confusion(predictions(s, d), ["lang"])
    return out.select("slice", "tag", "tp", "fp", "fn", "tn", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query(
    "slice_kinds",
    f"WITH {_SLICES_SQL} SELECT kind, slice, model, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1 FROM c",
)
def slice_kinds(s, d):
    return _sliced(s, d).select("kind", "slice", "model", "tp", "fp", "fn", "tn", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query(
    "promotion_by_slice",
    f"""WITH {_SLICES_SQL}, m AS (SELECT kind || ':' || slice AS slice, 'toxic' AS tag, model, {_F1} AS f1, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c),
    w AS (SELECT slice, tag, max(f1) FILTER (WHERE model = 'champion') AS hf, max(f1) FILTER (WHERE model = 'candidate') AS cf,
      max(recall) FILTER (WHERE model = 'champion') AS hr, max(recall) FILTER (WHERE model = 'candidate') AS cr FROM m GROUP BY slice, tag)
    SELECT slice, tag, round(hf, 6) AS champion_f1, round(cf, 6) AS candidate_f1, round(hr, 6) AS champion_recall, round(cr, 6) AS candidate_recall,
      CASE WHEN slice IN ('language:hi-en', 'context:true') THEN cf > hf ELSE true END AS f1_ok, cr >= hr AS recall_ok,
      CASE WHEN slice IN ('language:hi-en', 'context:true') THEN cf > hf ELSE true END AND cr >= hr AS promote FROM w""",
)
def promotion_by_slice(s, d):
    slices = _sliced(s, d).select("model", F.concat_ws(":", "kind", "slice").alias("slice"), F.lit("toxic").alias("tag"), "f1", "recall")
    out = E.promotion_check(slices, ["language:hi-en", "context:true"], ["toxic"])
    rounded = [F.round(x, 6).alias(x) for x in ("champion_f1", "candidate_f1", "champion_recall", "candidate_recall")]
    return out.select("slice", "tag", *rounded, "f1_ok", "recall_ok", "promote")


@query(
    "promotion_check",
    f"""WITH {_PRED}, {_DPRED}, m AS (SELECT 'candidate' AS model, lang, tag, {_F1} AS f1, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM ({confusion_sql('pred', 'lang, tag')})
      UNION ALL SELECT 'champion', lang, tag, {_F1}, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) FROM ({confusion_sql('dpred', 'lang, tag')})),
    w AS (SELECT lang AS slice, tag, max(f1) FILTER (WHERE model = 'champion') AS hf, max(f1) FILTER (WHERE model = 'candidate') AS cf,
      max(recall) FILTER (WHERE model = 'champion') AS hr, max(recall) FILTER (WHERE model = 'candidate') AS cr FROM m GROUP BY lang, tag)
    SELECT slice, tag, round(hf, 6) AS champion_f1, round(cf, 6) AS candidate_f1, round(hr, 6) AS champion_recall, round(cr, 6) AS candidate_recall,
      CASE WHEN slice IN ('en', 'de') THEN cf > hf ELSE true END AS f1_ok, CASE WHEN tag = 'obscene' THEN cr >= hr ELSE true END AS recall_ok,
      CASE WHEN slice IN ('en', 'de') THEN cf > hf ELSE true END AND CASE WHEN tag = 'obscene' THEN cr >= hr ELSE true END AS promote FROM w""",
)
def promotion_check(s, d):
    def slices(long, model):
        return E.confusion(long, ["lang", "tag"]).select(
            F.lit(model).alias("model"), c("lang").alias("slice"), "tag", "f1", "recall"
        )

    both = slices(predictions(s, d), "candidate").unionByName(slices(derived_predictions(s, d), "champion"))
    out = E.promotion_check(both, ["en", "de"], ["obscene"])
    rounded = [F.round(x, 6).alias(x) for x in ("champion_f1", "candidate_f1", "champion_recall", "candidate_recall")]
    return out.select("slice", "tag", *rounded, "f1_ok", "recall_ok", "promote")


__all__ = ["k"]
