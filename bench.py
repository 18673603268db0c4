"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modspark import catalog  # noqa: E402
from modspark.session import local_session  # noqa: E402

HEADLINE = [
    "moderate_end_to_end",
    "normalize_for_toxicity",
    "detect_language",
    "lexicon_score",
    "ngram_langid",
    "scrub_rewrite",
    "masked_text",
    "cascade_scores",
    "rate_limit",
    "history_last5",
    "near_duplicate_messages",
    "unify_sources",
    "dedup_keep_first",
    "stratified_split",
    "rare_rescue",
    "language_mix",
    "length_profile",
    "script_ratio",
    "optimal_threshold",
    "eval_per_split",
    "threshold_gain",
    "retrain_batches",
    "feedback_stats",
    "ops_metrics",
    "policy_actions",
    "message_store",
    "stream_rate_limit",
    "stream_moderation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores))
    spark.read.parquet(f"{folder}/documents.parquet").count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
