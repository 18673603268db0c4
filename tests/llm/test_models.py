"""Language identification and quality scores: held-out accuracy, odd rows, exact traversal."""

import random
import zlib

import numpy as np
import pytest

from modspark.llm import langid, quality

SOUNDS = {"en": "th er an in re he on at", "de": "sch ein ung der ich ge en ü", "fr": "eau oi ée qu les ai è", "es": "ción ña os la que ar ll", "xx": "zz qx kk vv ww yy"}


def prose(rng, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rem(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, prose(rng, lang, rng.randint(3, 60)), lang, "s", "x"))
    return rows


def test_languages(spark, corpus):
    odd = [(5000, None, "en", "s", "x"), (5001, "", "en", "s", "x"), (5002, "12 34 !", "fr", "s", "x"), (None, "schein ungder ich", None, None, None)]
    odd += [(5003, "schein ungder gench " * 30_000, None, None, None), (5004, "日本語", None, "s", "x"), corpus[0], corpus[0]]
    df = spark.createDataFrame(corpus + odd, "doc_id long, text string, lang string, score string, lang_pred string")
    got = langid.predict_languages(df, sample=400).collect()
    assert len(got) == len(corpus) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and rem(r.doc_id, 3) == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*SOUNDS, "und"} for r in got)
    assert [by[i].lang_pred for i in (5000, 5001, 5002, 5003, None)] == ["und", "und", "und", "de", "de"]
    assert by[5004].lang_pred in SOUNDS
    right = [by[i].lang_pred == lang for i, _, lang, *_ in corpus if rem(i, 3) == 1]
    assert np.mean(right) > 0.98


def test_labels_of_held_out_rows_are_not_learned(spark, corpus):
    rows = [(i, t, lang if rem(i, 3) != 1 else "wrong") for i, t, lang, *_ in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert "wrong" not in {r.lang_pred for r in langid.predict_languages(df).collect()}


def test_languages_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.predict_languages(df).collect()} == {("und", 0.0)}
    assert langid.predict_languages(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "text", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict_languages(one).collect()} == {"en"}


def test_numeric_signs_are_no_letters(spark, corpus):
    odd = [(9001, "\u00bd \u00b2"), (9002, "\u2167 \u2462"), (9003, "\u0663"), (9004, "7 \u00aa")]
    df = spark.createDataFrame([r[:3] for r in corpus] + [(*r, None) for r in odd], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in langid.predict_languages(df, sample=300).collect()}
    assert [(by[i].lang_pred, by[i].score) for i in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert by[9004].lang_pred != "und"  # an ordinal sign is a letter


def test_repeated_rows_change_no_draw(spark, corpus):
    df = spark.createDataFrame([r[:3] for r in corpus] + [corpus[0][:3]] * 3000, "doc_id long, text string, lang string")
    a, b = (langid.train(df.repartition(n), sample=200) for n in (2, 7))
    assert (a.first == b.first).all() and a.pairs.keys() == b.pairs.keys() and all((a.pairs[k] == b.pairs[k]).all() for k in a.pairs)


def slow_machine(x, y, cost=50.0, steps=150):
    """The same descent row by row in double precision."""
    n = {s: sum(1 for v in y if v == s) for s in (-1, 1)}
    rate = 1 / (1 + 4 * cost)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        grad = v.copy()
        for row, sign in zip(x, y, strict=True):
            grad -= 2 * cost * 0.5 / n[sign] * max(0.0, 1 - sign * float(row @ v)) * sign * row
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def test_families_votes_and_score_by_plain_loops(spark, corpus):
    """Every machine, the family, the votes within it and the score, from the features on."""
    langs = sorted(SOUNDS)
    own = [r for code in langs for r in [c for c in corpus if c[2] == code][:25]]
    dim = 256
    x = np.append(langid.features([r[1] for r in own], dim), np.ones((len(own), 1), np.float32), 1)
    lang = [r[2] for r in own]
    model = langid.fit(x, lang)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    double = x.astype(float)
    first = [slow_machine(double, [1 if langid.family(c) == f else -1 for c in lang]) for f in model.families]
    assert np.allclose(first, model.first, atol=2e-2)
    for (i, j), w in model.pairs.items():
        at = [k for k, c in enumerate(lang) if c in (i, j)]
        assert np.allclose(slow_machine(double[at], [1 if lang[k] == i else -1 for k in at]), w, atol=2e-2)
    test = langid.features([r[1] for r in corpus[600:700]], dim)
    got, score = model.predict(test)
    for row, name, s in zip(test, got, score, strict=True):
        row = np.append(row, 1.0)
        e = [np.exp(3 * float(row @ w)) for w in model.first]
        best = int(np.argmax(e))
        members = model.members[model.families[best]]
        votes, margin = dict.fromkeys(members, 0.0), dict.fromkeys(members, 0.0)
        for (i, j), w in model.pairs.items():
            if i in members:
                p = 1 / (1 + np.exp(-3 * float(row @ w)))
                votes[i if p > 0.5 else j] += 1
                margin[i] += p
                margin[j] += 1 - p
        pick = max(members, key=lambda c: votes[c] + margin[c] / len(members) / 2)
        want = e[best] / sum(e) * (margin[pick] / (len(members) - 1) if len(members) > 1 else 1)
        assert name == pick and abs(s - want) < 1e-4


def test_families():
    assert langid.family("de") == langid.family("en-GB") != langid.family("fr") == langid.family("es")
    assert langid.family("tlh") == "tlh"


def walk(trees, row):
    total = trees.base
    for node in trees.roots:
        while trees.feature[node] >= 0:
            node = trees.left[node] + (row[trees.feature[node]] > trees.cut[node])
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_is_the_walk():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 6)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(float)
    trees = quality.fit(x, y, trees=30)
    new = np.round(rng.normal(size=(300, 6)), 1)
    assert np.allclose(trees.score(new), [walk(trees, r) for r in new], atol=1e-12)
    want = (new[:, 0] > 0.3) ^ (new[:, 1] * new[:, 2] > 0.1)
    assert ((trees.score(new) > 0.5) == want).mean() > 0.85
    assert set(quality.fit(x, np.ones(500)).score(x)) == {quality.fit(x, np.ones(500)).score(x[:1])[0]}


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        text = prose(rng, rng.choice(list(SOUNDS)), rng.randint(10, 60))
        bad = rng.random() < 0.3
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w for w in text.split()[:5] for _ in range(12)), text.replace(" ", "%%% ")])
        rows.append((i, text, "en", 0.5))
        if i % 2:
            labels.append((i, int(not bad), 0, "x"))
        rows[-1] = (*rows[-1][:3], float(not bad))
    odd = [(9000, None, None, None), (9001, "", None, None), (None, "word " * 9, None, None), (9002, "a b c " * 50_000, None, None), rows[0], rows[0]]
    labels += [(None, 1, 0, "x"), (3, None, 0, "x"), (7, 5, 0, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, quality string, score double")
    got = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and rem(r.doc_id, 5) == 0) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    held = [by[i] == int(good) for i, _, _, good in rows if rem(i, 5) == 0]
    assert np.mean(held) > 0.97
    none = docs.limit(0)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(none, no_labels).count() == 0
    assert {r.predicted for r in quality.quality_scores(docs, no_labels).collect()} == {1}
