"""Headline queries, timed: one JSON line on standard output.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_ALL=1 for all queries.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pulsemill.session import local_session  # noqa: E402
from queryset import QUERIES  # noqa: E402

HEADLINE = [
    "prediction_summary", "quality_roc_auc", "threshold_choice", "cascade_report",
    "gate_on_common_windows", "activity_report", "hr_errors", "sample_series", "tumbling_windows",
    "paired_windows", "label_as_of", "watch_registry", "series_position", "window_zscore",
    "window_resample", "window_periodogram", "ppg_features", "feature_table", "feature_scaler",
    "dominant_frequency_hr", "subject_strata", "subject_split", "low_data_subsets",
    "registry_with_split", "annotated_records", "hr_answers", "quality_answers",
    "answers_to_predictions", "tensor_mart", "prompt_records", "main_comparison", "seed_spread",
    "median_hr", "trivial_predictions", "logistic_baseline", "ridge_baseline", "external_scorer",
    "registry_violations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cores, **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    seconds = {}
    for name in ("ppg_features", "prediction_summary"):  # start Python workers and warm the JVM
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
