"""Headline queries, timed to full output; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairforge.queries.catalog import QUERIES  # noqa: E402
from pairforge.session import local_session  # noqa: E402

HEADLINE = [
    "pref_outcomes", "pref_pairs", "pref_numbered", "pref_from_hook", "running_success",
    "split_90_10", "seeded_shuffle", "bleu_words", "bleu_by_lang", "bleu_corpus", "bleu_running",
    "vocab", "token_ids", "left_pad", "completion_labels", "batch_flatten", "pack_wrapped",
    "pack_best_fit", "runs_table", "summary_global", "summary_by_method", "box_by_method",
    "plan_outcomes", "learning_curve", "reward_metrics_dpo",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["split_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    pairs = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "preference_rows_per_sec": round(pairs / seconds["pref_outcomes"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
