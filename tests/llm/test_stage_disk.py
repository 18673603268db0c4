"""What the steps on documents leave in the shared folder, and what they shuffle."""

import os

from modspark.llm import minhash, suffix
from modspark.session import shared_dir


def test_near_duplicates_leave_their_result(spark):
    def left():
        folder = shared_dir(spark).removeprefix("file:")
        return {x for x in os.listdir(folder)}

    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other"), (4, None), (4, None)], "doc_id long, text string")
    before = left()
    out = minhash.near_duplicates(docs)
    assert {x.rsplit("-", 1)[0] for x in left() - before} == {"near_classes"}
    assert sorted((r.doc_id, r.class_id, r.kept) for r in out.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (4, 4, True)]


def test_cut_passages_shuffles_texts_once(spark):
    """Texts are dealt by document once: the rows that come back are the ones that were cut."""
    rows = [(i % 7, f"a passage of well over fifty bytes that documents have in common {i % 3}", i, [i]) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n long, list array<int>")
    out = suffix.cut_passages(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "first(kept_text" not in plan and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 2
    cut = {(r.doc_id, r.kept_sha256): r for r in suffix.repeated_passages(docs, with_text=True).collect()}
    got = out.collect()
    assert sorted((r.doc_id, r.n, r.list) for r in got) == sorted((r[0], r[2], r[3]) for r in [*rows, rows[0]])
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.kept_text) for r in cut.values()}
