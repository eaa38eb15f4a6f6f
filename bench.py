"""Time the headline queries at $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tallyframe.plans.catalog import QUERIES
from tallyframe.session import local_session

HEADLINE = (
    "point_metrics_by_leaf",
    "overall_with_flags",
    "leaf_by_format",
    "by_flag_slices",
    "by_video",
    "latency_profile_big",
    "three_views_of_accuracy",
    "dataset_gap_decomposition",
    "normalize_documents",
    "normalize_answers",
    "score_answers",
    "detections_to_counts",
    "time_diagnostics",
    "numeric_diagnostics",
    "set_diagnostics",
    "label_diagnostics",
    "paired_contingency",
    "wilcoxon_test",
    "paired_video_interval",
    "rule_sweep",
    "calibration_gain",
    "frame_plan",
    "frame_coverage",
    "case_priority",
    "completion_gate",
    "run_matrix",
    "completeness",
    "seeded_subset",
    "stratified_subset",
    "balanced_count_distribution",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["point_metrics_by_leaf"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
