"""Metrics against hand counts and brute force."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsemill.operators import gates, metrics
from pulsemill.operators.constraints import unscorable_runs


def frame(spark, truth, decided, prob=None, task="quality", run="r"):
    prob = prob if prob is not None else [None] * len(truth)
    cast = lambda v: None if v is None else float(v)
    rows = [
        (run, f"{run}{i}", task, cast(t), cast(d), cast(p), "invalid" if d is None else "ok")
        for i, (t, d, p) in enumerate(zip(truth, decided, prob))
    ]
    return spark.createDataFrame(
        rows,
        "run_id STRING, record_id STRING, task STRING, y_true DOUBLE, y_pred DOUBLE, "
        "prob_good DOUBLE, parse_status STRING",
    )


def brute_auc(truth, prob):
    pairs = [(p > n) + 0.5 * (p == n) for t, p in zip(truth, prob) if t == 1
             for u, n in zip(truth, prob) if u == 0]
    return float(np.mean(pairs)) if pairs else None


def brute_macro_f1(truth, decided):
    scores = []
    for c in sorted(set(truth) | set(decided)):
        tp = sum(t == c and d == c for t, d in zip(truth, decided))
        wrong = sum((t == c) != (d == c) for t, d in zip(truth, decided))
        scores.append(2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0)
    return float(np.mean(scores))


def test_perfect_and_all_wrong(spark):
    perfect = metrics.quality_metrics(frame(spark, [0, 1, 1], [0, 1, 1])).first()
    wrong = metrics.quality_metrics(frame(spark, [0, 1, 1], [1, 0, 0])).first()
    assert (perfect["macro_f1"], perfect["accuracy"]) == (1.0, 1.0)
    assert (wrong["macro_f1"], wrong["accuracy"]) == (0.0, 0.0)
    assert perfect["confusion_matrix"] == [[1, 0], [0, 2]]
    assert perfect["roc_auc"] is None  # no score at all


def test_macro_f1_counts_present_classes_only(spark):
    one = metrics.quality_metrics(frame(spark, [1, 1], [1, 1])).first()
    assert one["macro_f1"] == 1.0  # class bad occurs nowhere
    two = metrics.quality_metrics(frame(spark, [1, 1], [1, 0])).first()
    assert two["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_auc_of_several_runs_at_once(spark, many_runs):
    rng = np.random.default_rng(9)
    frames, want = [], {}
    for run, n in (("a", 500), ("b", 20), ("c", 7)):
        truth, prob = rng.integers(0, 2, n).tolist(), rng.integers(0, 90, n) / 90
        frames.append(frame(spark, truth, truth, prob.tolist(), run=run))
        want[run] = brute_auc(truth, prob.tolist())
    both = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = {r["run_id"]: r["roc_auc"] for r in metrics.roc_auc(both).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    pair = {r["run_id"]: r["roc_auc"] for r in metrics.roc_auc(both, ["run_id", "task"]).collect()}
    assert pair == got


def test_auc_single_class_is_null(spark):
    row = metrics.roc_auc(frame(spark, [1, 1], [1, 1], [0.2, 0.9])).first()
    assert row["roc_auc"] is None


def test_auc_and_threshold_on_awkward_scores(spark, many_runs):
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 300).tolist()
    grid = (rng.integers(0, 201, 100) * 0.005).tolist()  # exactly on the threshold grid
    near = (0.5 + rng.integers(0, 3, 100) * 2.0**-40).tolist()  # part only below 2**-30
    scores = grid + near + rng.random(90).tolist() + [0.0, 1.0] * 5
    df = frame(spark, truth, [1] * 300, scores)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(brute_auc(truth, scores), abs=1e-12)
    curve = {round(r["threshold"] / 0.005): r["macro_f1"] for r in metrics.threshold_curve(df).collect()}
    want = {
        k: brute_macro_f1(truth, [int(s >= np.linspace(0, 1, 201)[k]) for s in scores])
        for k in range(1, 200)
    }
    assert curve == pytest.approx(want)
    best = metrics.best_threshold(df).first()
    first = min(k for k in want if want[k] == max(want.values()))
    assert best["threshold"] == pytest.approx(first * 0.005)
    assert metrics.fitted_threshold(df) == best["threshold"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.floats(0, 1)), min_size=2, max_size=40))
def test_auc_properties(spark, rows):
    truth, prob = zip(*rows)
    auc = metrics.roc_auc(frame(spark, truth, truth, prob)).first()["roc_auc"]
    if len(set(truth)) < 2:
        assert auc is None
    else:
        assert auc == pytest.approx(brute_auc(truth, prob), abs=1e-12)


def test_separable_scores_give_full_f1(spark):
    df = frame(spark, [0, 0, 1, 1], [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    best = metrics.best_threshold(df).first()
    assert best["macro_f1"] == 1.0 and 0.2 < best["threshold"] <= 0.8


def test_hr_errors(spark):
    row = metrics.hr_metrics(frame(spark, [60, 70, 80], [62, 70, 76], task="hr")).first()
    assert (row["n"], row["mae"]) == (3, 2.0)
    assert row["rmse"] == pytest.approx((20 / 3) ** 0.5)


def test_unreadable_answers_are_kept_and_counted(spark):
    df = frame(spark, [60, 70, 80], [60, None, None], task="hr")
    row = metrics.evaluate(df).first()
    assert (row["n_records"], row["n_scored"], row["n_invalid_responses"]) == (3, 1, 2)
    assert row["invalid_response_fraction"] == pytest.approx(2 / 3)
    assert row["mae"] == 0.0 and row["macro_f1"] is None
    nothing = frame(spark, [1, 0], [None, None])
    row = metrics.evaluate(nothing).first()
    assert row["n_scored"] == 0 and row["macro_f1"] is None and row["accuracy"] is None
    assert unscorable_runs(nothing).count() == 1


def test_report_json(spark):
    both = frame(spark, [1, 0], [1, 0], [0.9, 0.1]).unionByName(
        frame(spark, [60], [63], task="hr", run="h")
    )
    out = {r["run_id"]: r["report"] for r in metrics.report_json(metrics.evaluate(both)).collect()}
    assert '"roc_auc":1.0' in out["r"] and '"mae":3.0' in out["h"]
    block = json.loads(out["r"])["metrics"]
    assert block["n"] == 2 and block["confusion_matrix"] == [[1, 0], [0, 1]] and block["confusion_matrix_labels"] == ["bad", "good"]
    assert block["per_class"]["1"] == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "support": 1}
    nothing = metrics.report_json(metrics.evaluate(frame(spark, [1, 0], [None, None]))).first()["report"]
    assert json.loads(nothing)["metrics"] is None


def test_reports_refuse_wrong_tasks_and_empty_input(spark):
    quality, hr = frame(spark, [1, 0], [1, 0]), frame(spark, [60, 70], [61, 73], task="hr")
    for build in (
        lambda: gates.pipeline_report(hr, hr), lambda: gates.pipeline_report(quality, quality), lambda: gates.cascade_report(hr),
        lambda: gates.cascade_report(quality, quality), lambda: gates.activity_report(quality, hr.selectExpr("record_id", "'a' AS activity")),
        lambda: metrics.evaluate(quality.unionByName(hr.withColumn("run_id", F.lit("r")))),
        lambda: gates.pipeline_report(quality, hr.where("record_id = 'none'")), lambda: gates.cascade_report(quality.limit(0)),
    ):
        with pytest.raises(Exception, match="not a|several tasks|no rows"):
            build().collect()


def test_cascade_hand_count(spark):
    quality = frame(spark, [1, 1, 1, 0, 0], [1, 1, 0, 1, None])
    hr = frame(spark, [60, 70, 80], [61, 73, 99], task="hr")
    row = gates.cascade_report(quality, hr).first()
    assert (row["n_test"], row["n_accepted"]) == (5, 3)
    assert row["accepted_fraction"] == pytest.approx(3 / 5)
    assert row["false_reject_rate"] == pytest.approx(1 / 3)
    assert row["false_accept_rate"] == pytest.approx(1 / 2)
    assert (row["hr_windows_scored"], row["mae"]) == (2, 2.0)
    assert gates.cascade_report(quality).first()["n_accepted"] == 3
    common = gates.pipeline_report(quality, hr).first()
    assert (common["n_windows"], common["n_accepted"], common["mae"]) == (3, 2, 2.0)
    assert common["false_accept_rate"] is None


def test_activity_report(spark):
    hr = frame(spark, [70, 72, 150, 155, 90], [71, 70, 120, 130, None], task="hr")
    registry = spark.createDataFrame(
        [("r0", "Standing"), ("r1", "Standing"), ("r2", "Running"), ("r4", "Running")],
        "record_id STRING, activity STRING",
    )
    rows = {(r["level"], r["activity"]): r for r in gates.activity_report(hr, registry).collect()}
    assert set(rows) == {("overall", None), ("activity", "Standing"), ("activity", "Running")}
    assert rows["overall", None]["n_windows"] == 5 and rows["activity", "Running"]["n_windows"] == 2
    assert rows["overall", None]["n"] == 4  # r3 has no activity but counts here
    assert rows["activity", "Running"]["mae"] == 30.0


def test_best_epoch_is_the_first_of_equals(spark):
    log = spark.createDataFrame(
        [("a", "quality", 1, 0.5, None), ("a", "quality", 2, 0.7, None), ("a", "quality", 3, 0.7, None),
         ("b", "hr", 1, None, 9.0), ("b", "hr", 2, None, 8.0)],
        "run_id STRING, task STRING, epoch INT, macro_f1 DOUBLE, mae DOUBLE",
    )
    got = {r["run_id"]: (r["epoch"], r["score"]) for r in metrics.best_epoch(log).collect()}
    assert got == {"a": (2, 0.7), "b": (2, -8.0)}


def test_accepted_share_counts_null_as_rejected(spark):
    df = frame(spark, [1, 1, 1, 1], [1, None, 0, 1])
    assert gates.accepted_share(df).first()[0] == 0.5
    assert F.col("x") is not None
