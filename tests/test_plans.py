"""Marts, models and comparison tables end to end."""

import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill import schemas
from pulsemill.operators import metrics
from pulsemill.operators.records import with_split
from pulsemill.operators.splits import subject_split
from pulsemill.plans import comparison, marts, predict, train
from pulsemill.sources import marts as mart_io
from pulsemill.sources import tables
from test_sources import ledger_file


@pytest.fixture(scope="module")
def registry(spark):
    """Tones whose rate is the label; bad windows are noise."""
    rng = np.random.default_rng(0)
    rows = []
    for s in range(10):
        for w in range(12):
            good, bpm = w % 4 > 0, 60 + 5 * ((s + w) % 12)
            x = np.sin(2 * np.pi * bpm / 60 * np.arange(300) / 30) * good + rng.normal(size=300) * (0.2 if good else 1)
            acc = rng.normal(size=(3, 400)).tolist() if w % 2 else None
            rows.append((f"{s}{w:02d}", f"S{s}", int(good), float(bpm) + 0.5, acc is not None, x.tolist(), acc,
                         "finger" if s % 2 else "ear", "M", 30.0 + s, 170.0, None, x.tolist() if w % 3 else None))
    table = spark.createDataFrame(
        rows, "record_id STRING, subject_id STRING, quality_label INT, hr_ref DOUBLE, has_acc BOOLEAN, "
        "ppg ARRAY<FLOAT>, acc ARRAY<ARRAY<FLOAT>>, measurement_site STRING, sex STRING, age DOUBLE, "
        "height DOUBLE, weight DOUBLE, ecg ARRAY<FLOAT>").withColumn("has_ecg", F.col("ecg").isNotNull())
    split = subject_split(table)
    return with_split(table, split).persist()


def test_tensor_mart_round_trip(spark, registry, tmp_path):
    mart = marts.tensor_mart(registry, "hr")
    mart_io.write_tensor_mart(mart, str(tmp_path / "t"))
    test = mart_io.read_tensor_mart(spark, str(tmp_path / "t"), "hr", "test")
    assert {len(r["x"]) for r in test.collect()} == {500} and test.count() == 2 * 9
    x = np.array(test.first()["x"])
    assert abs(x.mean()) < 1e-6 and x.std() == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError, match="no rows"):
        mart_io.read_tensor_mart(spark, str(tmp_path / "t"), "quality", "test")
    flat = marts.tensor_mart(registry, "quality", normalize="minmax")
    assert flat.select(F.max(F.array_max("x")), F.min(F.array_min("x"))).first()[:] == (1.0, -1.0)


def test_subject_packs_are_cut_into_bounded_parts(registry):
    packed = marts.subject_tensors(marts.tensor_mart(registry, "quality"), rows_per_part=4)
    rows = packed.collect()
    ids = [i for r in rows for i in r["record_ids"]]
    assert len(ids) == len(set(ids)) == 120 and len(rows) > 10
    assert all(r["record_ids"] == sorted(r["record_ids"]) and len(r["x"][0]) == 1 for r in rows)
    assert packed.schema["y"].dataType.simpleString() == "array<bigint>"


def test_prompt_mart_round_trip(spark, registry, tmp_path):
    mart = marts.prompt_mart(registry, "hr", acc_mode="axes")
    sizes = {r["has_acc"]: r["n"] for r in mart.join(registry.select("record_id", "has_acc"), "record_id")
             .select("has_acc", F.size("time_series").alias("n")).distinct().collect()}
    assert sizes == {True: 4, False: 1}
    mart_io.write_prompt_mart(mart, str(tmp_path / "p"))
    back = mart_io.read_prompt_mart(spark, str(tmp_path / "p"), "hr", "test", mart.schema)
    row = back.orderBy("record_id").first()
    assert row["answer"] == str(round(row["hr_ref"])) and row["post_prompt"].endswith("'Answer: <hr_bpm>'")
    entry = row["time_series"][0]
    assert entry["text"].startswith("This is the PPG signal, it has mean ") and len(entry["series"]) == 300
    counts = {r["split"]: r["windows"] for r in marts.manifest(mart, seed=42).collect()}
    assert sum(counts.values()) == 90


def test_prompt_mart_variants(registry):
    ecg = marts.prompt_mart(registry, "quality", signal="ecg")
    assert ecg.count() == 80 and "ECG signal" in ecg.first()["time_series"][0]["text"]
    with pytest.raises(ValueError, match="has_ecg"):
        marts.prompt_mart(registry.drop("has_ecg"), "quality", signal="ecg")
    with pytest.raises(ValueError, match="acc_mode"):
        marts.prompt_mart(registry, "quality", acc_mode="all")
    unknown = registry.withColumn("quality_label", F.when(F.col("subject_id") != "S1", F.col("quality_label")))
    kept, quarantine = marts.answered(marts.prompt_mart(unknown, "quality", "none"))
    assert (kept.count(), quarantine.count()) == (108, 12)


def test_logistic_baseline_finds_the_noise(registry):
    model, made = train.train_and_predict(registry, "quality")
    assert 0 < model.threshold < 1 and made.columns == schemas.PREDICTIONS.names
    row = metrics.evaluate(made.withColumn("run_id", F.lit("r"))).first()
    assert row["n_scored"] == 24 and row["macro_f1"] > 0.9 and row["roc_auc"] > 0.95


def test_logistic_solution_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.5, -1, 0.3] + rng.normal(size=200) > 0.7).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "ppg_a DOUBLE, ppg_b DOUBLE, ppg_c DOUBLE, label DOUBLE")
    df = train.balanced_weights(df)
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=["ppg_a", "ppg_b", "ppg_c"], outputCol="features").transform(df)
    fitted = train.estimator("quality", "logreg", df).fit(vec)
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    a = np.column_stack([x, np.ones(200)])
    beta = np.zeros(4)
    ridge = np.diag([1.0, 1, 1, 0])
    for _ in range(50):  # Newton steps on sum(w * loss) + |b|^2 / 2
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (weight * (p - y)) + ridge @ beta
        beta -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, grad)
    assert np.allclose([*fitted.coefficients, fitted.intercept], beta, atol=1e-4)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2] + 1
    y = x @ [2.0, -1, 7] + rng.normal(size=80) + 50
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "ppg_a DOUBLE, ppg_b DOUBLE, ppg_c DOUBLE, label DOUBLE")
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=["ppg_a", "ppg_b", "ppg_c"], outputCol="features").transform(df)
    fitted = train.estimator("hr", "ridge", df).fit(vec)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(fitted.coefficients, want, atol=1e-8)


def test_ridge_then_saved_model_on_other_data(spark, registry, tmp_path):
    model, made = train.train_and_predict(registry, "hr", "ppg_acc")
    assert metrics.evaluate(made.withColumn("run_id", F.lit("r"))).first()["mae"] < 10
    model.save(spark, str(tmp_path / "m"))
    loaded = train.FeatureModel.load(spark, str(tmp_path / "m"))
    target = predict.target_rows(registry.where("split = 'test' AND quality_label = 1 AND has_acc"))
    again = predict.predict_saved(loaded, target)
    a, b = ({r["record_id"]: r["y_pred"] for r in d.collect()} for d in (made, again))
    assert a == pytest.approx(b) and len(a) > 0


def test_boosted_trees_run(registry):
    _, made = train.train_and_predict(registry, "quality", kind="trees", rounds=2)
    assert made.where("prob_good BETWEEN 0 AND 1").count() == 24
    with pytest.raises(ValueError, match="unknown estimator"):
        train.train_and_predict(registry, "hr", kind="forest")


def test_external_scorer(registry):
    out = predict.score_windows(registry, lambda m: m[:, 0] * 0 + 2.0, "ppg", "quality")
    row = out.first()
    assert row["y_pred"] == 1.0 and row["prob_good"] == pytest.approx(1 / (1 + np.exp(-2)))
    hr = predict.score_windows(registry, lambda m: m.shape[1] + 0 * m[:, 0], "ppg", "hr")
    assert {r["y_pred"] for r in hr.collect()} == {300.0}


def test_stored_scorer_is_loaded_once_per_process(registry, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()
    model = tmp_path / "weight.txt"
    model.write_text("2.5")

    def load(path):
        with open(path) as f:
            weight = float(f.read())
        (log / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def scorer(matrix):
            assert matrix.nbytes <= 10 * 300 * 8
            return matrix[:, 0] * 0 + weight + os.getpid() * 1e6

        return scorer

    spread = registry.repartition(16)
    pids = set()
    for _ in range(2):
        out = predict.score_stored(spread, load, str(model), "ppg", "hr", max_bytes=10 * 300 * 8)
        values = [r["y_pred"] for r in out.collect()]
        assert len(values) == registry.count() and {v % 1e6 for v in values} == {2.5}
        pids |= {int(v // 1e6) for v in values}
    loads = [int(p.name.split("-")[0]) for p in log.iterdir()]
    assert sorted(loads) == sorted(set(loads)) == sorted(pids)


def test_stored_scorer_without_windows(spark, registry, tmp_path):
    def load(path):
        return lambda m: m.sum(axis=1)

    gaps = registry.limit(2).withColumn("ppg", F.when(F.col("record_id") == "none", F.col("ppg")))
    out = predict.score_stored(gaps, load, str(tmp_path), "ppg", "quality").collect()
    assert [r["y_pred"] for r in out] == [None, None]
    assert predict.score_stored(registry.limit(0), load, str(tmp_path), "ppg", "hr").count() == 0


def test_predict_run_needs_what_the_run_needs(spark, registry, tmp_path):
    ledger_file(tmp_path, "median")
    ledger_file(tmp_path, "bare", model="baseline_features")
    ledger_file(tmp_path, "broken", status="failed")
    ledger_file(tmp_path, "net", model="cnn1d", best_checkpoint="somewhere")
    runs = tables.read_ledger(spark, str(tmp_path / "*" / "run.json"))
    test, fit_on = (registry.where(f"split = '{fold}' AND quality_label = 1") for fold in ("test", "train"))
    for run_id, text in (("none", "no such run"), ("median", "training rows"), ("bare", "no checkpoint"),
                         ("broken", "failed, not finished"), ("net", "no way to predict")):
        with pytest.raises(ValueError, match=text):
            predict.predict_run(runs, run_id, test)
    made = predict.predict_run(runs, "median", test, fit_on)
    row = predict.rerun_record(runs, "median", "again", "2026-02-02", made).first()
    assert row["run_id"] == "again" and row["metrics"]["n"] == test.count() and row["metrics"]["macro_f1"] is None
    net = predict.predict_run(runs, "net", test, loaders={"cnn1d": lambda path: lambda m: m[:, 0] * 0 + len(path)})
    assert {r["y_pred"] for r in net.collect()} == {9.0}


def test_comparison_tables(spark, tmp_path):
    q = lambda f1: {"macro_f1": f1, "accuracy": 0.8, "roc_auc": 0.7}
    ledger_file(tmp_path, "old", model="cnn1d", task="quality", created_at="2026-01-01", metrics=q(0.1))
    ledger_file(tmp_path, "new", model="cnn1d", task="quality", created_at="2026-01-03", metrics=q(0.6))
    ledger_file(tmp_path, "bad", model="cnn1d", task="quality", created_at="2026-01-09", status="failed", metrics={})
    ledger_file(tmp_path, "acc", model="cnn1d", task="quality", created_at="2026-01-05", config={"input_variant": "ppg_acc"}, metrics=q(0.5))
    ledger_file(tmp_path, "llm", model="opentslm", config={"llm_id": "m/L-3.2-1B"}, metrics={"mae": 11.4, "rmse": 14.9})
    ledger = tables.read_ledger(spark, str(tmp_path / "*" / "run.json"))
    rows = comparison.main_table(ledger).collect()
    assert [r["model"] for r in rows][4:6] == ["1D-CNN / ResNet1D", "OpenTSLM-1B"] and len(rows) == 8
    assert rows[4]["quality_macro_f1"] == 0.6 and rows[5]["hr_mae"] == 11.4 and rows[0]["hr_mae"] is None
    ext = {r["model"]: r for r in comparison.extended_table(ledger).collect()}
    cnn = ext["1D-CNN / ResNet1D"]
    assert (cnn["ppg"], cnn["ppg_acc"], cnn["ppg_acc_cov"]) == (0.6, 0.5, None)
    listed = comparison.run_list(ledger).collect()
    assert [r["run_id"] for r in listed][:2] == ["bad", "acc"] and listed[0]["primary"] == "-"
    assert {r["primary"] for r in listed} >= {"macro_f1=0.6000", "MAE=11.400"}


def test_low_data_report(spark, tmp_path):
    for seed, f1 in ((0, 0.5), (1, 0.7), (2, None)):
        ledger_file(tmp_path / "runs", f"r{seed}", model="cnn1d", task="quality",
                    config={"split": f"/x/f25_s{seed}.json"}, metrics={"macro_f1": f1, "accuracy": 0.9})
    ledger_file(tmp_path / "runs", "gone", model="cnn1d", task="quality", config={"split": "/x/none.json"}, metrics={"macro_f1": 0.0})
    for seed in range(3):
        (tmp_path / f"f25_s{seed}.json").write_text(json.dumps({
            "seed": seed, "ratios": [0.6, 0.2, 0.2], "train_subjects": ["a"], "val_subjects": ["b"],
            "test_subjects": ["c"], "low_data": {"fraction": 0.25, "seed": seed, "n_train_subjects": 1}}))
    runs = comparison.low_data_runs(
        tables.read_ledger(spark, str(tmp_path / "runs" / "*" / "run.json")),
        tables.read_split(spark, str(tmp_path / "f25_*.json")))
    row = comparison.seed_spread(runs).first()
    assert (row["model"], row["n_seeds"], row["n_train_subjects"], row["metric"]) == ("1D-CNN / ResNet1D", 3, 1, "macro_f1")
    assert row["mean"] == pytest.approx(0.6) and row["std"] == pytest.approx(0.1) and row["rmse"] is None
