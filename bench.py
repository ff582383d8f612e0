"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog import QUERIES
from handful.session import build_session

HEADLINE = [
    "centroid_head_scores",
    "sample_per_class",
    "sample_per_class_with_text",
    "fewshot_splits",
    "balanced_downsample",
    "train_test_split_exact",
    "confusion_at_volume",
    "f1_and_mcc_at_volume",
    "classification_report",
    "average_precision_distinct_scores",
    "error_summary",
    "summarize",
    "compare",
    "shot_scaling",
    "dedupe_runs",
    "unwrap_records",
    "contrastive_pairs",
    "balance_pairs_oversampling",
    "pair_counts",
    "drawn_pairs",
    "drawn_pair_similarity",
    "linear_score",
    "predict_labels",
    "embed_hashed_words",
    "supcon_loss",
    "mine_triplets_hard",
    "shuffle_words",
    "pattern_label_grid",
    "token_f1",
    "extract_aspects",
    "fit_head",
    "fit_adapter",
    "fewshot_benchmark",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed: starts the JVM's compiler and the Python workers, so that no query pays for them.
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
