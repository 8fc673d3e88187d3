"""Windows and as-of labels against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import windows
from pulsemill.plans.process import watch_windows


def series(spark, lengths):
    rows = [(s, i, float(100 * k + i)) for k, (s, n) in enumerate(lengths.items()) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id STRING, idx BIGINT, value DOUBLE").repartition(3)


def test_only_complete_windows_in_order(spark):
    got = windows.tumbling_windows(series(spark, {"a": 10, "b": 3, "c": 4}), 4)
    rows = {(r["subject_id"], r["window_idx"]): r["x"] for r in got.collect()}
    assert rows == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 5, 6, 7], ("c", 0): [200, 201, 202, 203]}


def test_time_windows_ignore_a_stuck_clock(spark):
    rows = [("a", 0.5 * i, float(i)) for i in range(8)] + [("a", 100.0, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "subject_id STRING, t DOUBLE, value DOUBLE")
    got = {r["window_idx"]: r["x"] for r in windows.time_windows(df, 2.0, 2.0).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]}


def test_pairs_keep_the_shorter_signal(spark):
    a = windows.tumbling_windows(series(spark, {"a": 12, "b": 4}), 4)
    b = windows.tumbling_windows(series(spark, {"a": 5}), 2)
    pairs = windows.pair_windows(a, b, ["subject_id"], ("_p", "_e"))
    assert sorted((r["subject_id"], r["window_idx"]) for r in pairs.collect()) == [("a", 0), ("a", 1)]


def test_window_ids_and_starts(spark):
    row = spark.createDataFrame([("P1", 7)], "s STRING, w BIGINT").select(
        windows.window_id(F.col("s"), F.col("w")), windows.window_start(F.col("w"), 10.0)).first()
    assert tuple(row) == ("P1_0007", 70.0)


@pytest.mark.parametrize("hot", [False, True])
def test_label_as_of_against_brute_force(spark, many_runs, hot):
    rng = np.random.default_rng(5)
    subject = (lambda: "s0") if hot else (lambda: f"s{rng.integers(0, 4)}")
    obs = [(f"w{i}", subject(), float(rng.integers(0, 60))) for i in range(400)]
    obs += [(f"x{i}", "s0", 30.0) for i in range(300)]  # many at one instant
    log = sorted({(subject(), float(rng.integers(5, 60)), f"act{rng.integers(0, 3)}") for _ in range(30)})
    log += [("s0", 30.0, f"act{i % 3}") for i in range(50)]
    ghosts = [("s0", None, "Ghost"), ("s1", None, "Ghost")]  # entries without a time label nothing
    got = windows.label_as_of(
        spark.createDataFrame(obs, "record_id STRING, subject_id STRING, t0 DOUBLE").repartition(4),
        spark.createDataFrame(log + ghosts, "subject_id STRING, t DOUBLE, activity STRING"),
        ["subject_id"], "t0", "t", "activity",
    )
    assert got.columns == ["record_id", "subject_id", "t0", "activity"]
    want = {}
    for rid, s, t0 in obs:
        past = [(t, a) for k, t, a in log if k == s and t <= t0]
        want[rid] = max(past)[1] if past else "unknown"
    assert {r["record_id"]: r["activity"] for r in got.collect()} == want


def test_watch_windows_drop_what_cannot_be_rated(spark):
    ppg = spark.createDataFrame(
        [("a", i, None if i == 9 else float(i)) for i in range(16)], "subject_id STRING, idx BIGINT, value DOUBLE")
    ecg = spark.createDataFrame(
        [("a", i, 500.0 if i < 4 else 70.0) for i in range(16)], "subject_id STRING, idx BIGINT, value DOUBLE")
    log = spark.createDataFrame([("a", 0.0, "Sitting"), ("a", 25.0, "Walking")], "subject_id STRING, t DOUBLE, activity STRING")
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    out = watch_windows(ppg, ecg, log, seconds=10.0, ppg_fs=0.4, ecg_fs=0.4, target_fs=0.4,
                        hr=F.when(mean.between(30, 220), mean), dataset="d")
    rows = {r["record_id"]: r for r in out.collect()}
    assert set(rows) == {"a_0001", "a_0003"}  # window 0: rate out of range, window 2: lost sample
    assert rows["a_0001"]["ppg"] == [-4.0, -5.0, -6.0, -7.0]
    assert (rows["a_0001"]["activity"], rows["a_0003"]["activity"]) == ("Sitting", "Walking")
    assert rows["a_0003"]["hr_ref"] == 70.0 and rows["a_0003"]["measurement_site"] == "wrist"
