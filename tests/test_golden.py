"""Published run folders, if there are any: GOLDEN_RUNS names a folder of run folders.

Each run folder holds run.json, predictions/*.csv and metrics/metrics.json.
"""

import glob
import json
import os

import pytest

from pulsemill.operators import metrics
from pulsemill.sources import tables

RUNS = os.environ.get("GOLDEN_RUNS")


@pytest.mark.skipif(not RUNS, reason="GOLDEN_RUNS is not set")
def test_published_metrics_are_reproduced(spark):
    predictions = tables.read_predictions(spark, f"{RUNS}/*/predictions/*.csv")
    ours = {r["run_id"]: r.asDict() for r in metrics.evaluate(predictions).collect()}
    assert ours
    for path in glob.glob(f"{RUNS}/*/metrics/metrics.json"):
        run = path.split("/")[-3]
        if run not in ours:
            continue
        with open(path) as f:
            published = json.load(f)
        for name, value in {**published, **published["metrics"]}.items():
            if name in ours[run] and name != "task":
                assert ours[run][name] == pytest.approx(value, abs=1e-12), (run, name)
