"""Files in, tables out, and back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill import schemas
from pulsemill.operators import constraints, splits
from pulsemill.plans import process
from pulsemill.sources import marts as mart_io
from pulsemill.sources import signals, tables, watch
from pulsemill.streaming import landing
from test_signals import spikes


@pytest.fixture
def raw(tmp_path):
    """Three channels, a legacy single channel, a wrong length, a broken file."""
    (tmp_path / "ppg").mkdir()
    rng = np.random.default_rng(0)
    rgb = rng.normal(size=(300, 3)).astype(np.float32)
    save = lambda rid, x, names: np.savez(tmp_path / "ppg" / f"{rid}.npz", p_signal=x, sig_name=np.array(names))
    save("100001", rgb, ["PPG_R", "PPG_G", "PPG_B"])
    save("100002", rgb, ["a", "b", "c"])
    save("101001", rgb[:, :1].T, ["PPG"])
    save("101002", rgb[:200], ["PPG_R", "PPG_G", "PPG_B"])
    (tmp_path / "ppg" / "102001.npz").write_bytes(b"not a zip")
    (tmp_path / "acc").mkdir()
    np.save(tmp_path / "acc" / "100001.npy", rng.normal(size=(3, 1000)).astype(np.float32))
    (tmp_path / "ecg").mkdir()
    np.save(tmp_path / "ecg" / "100001.npy", np.cos(2 * np.pi * 10 * np.arange(10000) / 10000))
    ann = "﻿ID,Quality,HR\n" + "".join(f"{r},{q},{h}\n" for r, q, h in [
        ("100001", 1, 71.5), ("100002", 0, 60), ("101001", 1, 80), ("101002", 1, 80), ("102001", 1, 90), ("103001", 1, 99)])
    (tmp_path / "ann.csv").write_text(ann, encoding="utf-8")
    info = "﻿ID,Gender,Age [years],Height [cm],Weight [kg],Ear/finger\n100001,M,30,180,75.5,1\n100002,F,40,170,,0\n"
    (tmp_path / "info.csv").write_text(info, encoding="utf-8")
    return tmp_path, rgb


def test_raw_to_registry(spark, raw):
    folder, rgb = raw
    registry, rejects = process.process(
        tables.read_annotations(spark, str(folder / "ann.csv")),
        tables.read_subject_info(spark, str(folder / "info.csv")),
        signals.read_raw_ppg(spark, str(folder / "ppg")),
        signals.read_matrices(spark, str(folder / "acc")),
        signals.read_windows(spark, str(folder / "ecg")),
        dataset="finger_study",
    )
    rows = {r["record_id"]: r for r in registry.collect()}
    assert set(rows) == {"100001", "100002", "101001"}  # 103001 was never ingested
    assert np.allclose(rows["100001"]["ppg"], rgb[:, 1]) and np.allclose(rows["100002"]["ppg"], rgb[:, 1])
    assert np.allclose(rows["101001"]["ppg"], rgb[:, 0])
    first = rows["100001"]
    assert (first["subject_id"], first["measurement_site"], first["sex"], first["age"]) == ("100", "finger", "M", 30.0)
    assert (first["has_acc"], first["has_ecg"], len(first["ecg"])) == (True, True, 300)
    assert np.allclose(first["ecg"], np.cos(2 * np.pi * 10 * np.arange(300) / 300), atol=1e-5)
    assert (rows["101001"]["measurement_site"], rows["101001"]["sex"], rows["101001"]["has_acc"]) == ("ear", "", False)
    assert rows["100002"]["weight"] is None
    reasons = {r["record_id"]: r["reject_reason"] for r in rejects.collect()}
    assert set(reasons) == {"101002", "102001"} and "expected 300" in reasons["101002"]

    out = str(folder / "registry")
    tables.write_registry(registry, out, ["finger_study"])
    again = tables.read_registry(spark, out, ["finger_study"])
    assert again.count() == 3 and dict(again.dtypes)["record_id"] == "string" and "has_ecg" in again.columns
    with pytest.raises(ValueError, match="dataset"):
        tables.read_registry(spark, out, ["other"])
    with pytest.raises(ValueError, match="duplicate"):
        tables.write_registry(registry.unionByName(registry), out)


def test_wrong_rank_is_rejected(spark, raw):
    row = signals.read_windows(spark, str(raw[0] / "acc")).first()
    assert row["x"] is None and "1 dimensions" in row["reject_reason"]


def test_landing_takes_new_files_once(spark, raw):
    folder = raw[0]
    args = (spark, str(folder / "ecg"), str(folder / "landed"), str(folder / "state"))
    assert landing.land_windows(*args) == 1
    assert landing.land_windows(*args) == 0
    np.save(folder / "ecg" / "200001.npy", np.zeros(5))
    assert landing.land_windows(*args) == 1
    landed = spark.read.parquet(str(folder / "landed"))
    assert sorted(r["record_id"] for r in landed.collect()) == ["100001", "200001"]
    for i in range(120):
        np.save(folder / "ecg" / f"3{i:05d}.npy", np.zeros(3))
    one = landing.land_new_files(spark, str(folder / "ecg"), "*.npy", signals.decode_windows, *args[2:], files_per_batch=1)
    assert one == 120  # more batches than a query remembers
    assert landing.land_ppg(spark, str(folder / "ppg"), str(folder / "l2"), str(folder / "s2")) == 5


def test_split_files(spark, tmp_path):
    split = spark.createDataFrame(
        [("c", "train"), ("a", "train"), ("b", "val"), ("d", "test")], "subject_id STRING, fold STRING")
    tables.write_split(split, str(tmp_path / "out"), 42, (0.6, 0.2, 0.2))
    again = tables.read_split(spark, str(tmp_path / "out")).collect()
    assert {(r["split_id"], r["subject_id"], r["fold"], r["seed"]) for r in again} == {
        ("out", i, f, 42) for i, f in (("c", "train"), ("a", "train"), ("b", "val"), ("d", "test"))}
    low = {"seed": 42, "ratios": [0.6, 0.2, 0.2], "train_subjects": ["a", "c"], "val_subjects": ["b"], "test_subjects": ["d"],
           "low_data": {"fraction": 0.5, "seed": 3, "n_train_subjects": 2}}
    (tmp_path / "f50_s3.json").write_text(json.dumps(low, indent=2))
    rows = tables.read_split(spark, str(tmp_path / "f50_s3.json")).collect()
    assert {(r["subject_id"], r["fold"]) for r in rows} == {("a", "train"), ("c", "train"), ("b", "val"), ("d", "test")}
    assert {(r["split_id"], r["fraction"], r["seed"], r["n_train_subjects"]) for r in rows} == {("f50_s3", 0.5, 3, 2)}
    (tmp_path / "leak.json").write_text(json.dumps({**low, "val_subjects": ["a"]}))
    with pytest.raises(ValueError, match="invalid"):
        tables.read_split(spark, str(tmp_path / "leak.json"))
    with pytest.raises(ValueError, match="invalid"):
        tables.write_split(split.unionByName(split.withColumn("fold", F.lit("test"))), str(tmp_path / "x"), 1, (1, 0, 0))


def predictions(spark):
    return spark.createDataFrame(
        [("00123", "001", "quality", 1.0, None, None, 'said "x",\nAnswer: maybe', "invalid"),
         ("00124", "001", "quality", 0.0, 1.0, 0.7, None, None)], schemas.PREDICTIONS)


def test_prediction_files_keep_ids_and_texts(spark, tmp_path):
    path = str(tmp_path / "run_a" / "predictions" / "p")
    tables.write_predictions(predictions(spark), path)
    for i, part in enumerate(sorted((tmp_path / "run_a" / "predictions" / "p").glob("part*.csv"))):
        (tmp_path / "run_a" / "predictions" / f"test{i}.csv").write_bytes(part.read_bytes())
    again = tables.read_predictions(spark, str(tmp_path / "*" / "predictions" / "*.csv"))
    rows = {r["record_id"]: r for r in again.collect()}
    assert set(rows) == {"00123", "00124"} and rows["00123"]["run_id"] == "run_a"
    assert rows["00123"]["raw_response"] == 'said "x",\nAnswer: maybe' and rows["00123"]["y_pred"] is None


def test_prediction_table_by_run(spark, tmp_path):
    both = predictions(spark).withColumn("run_id", F.lit("a")).unionByName(
        predictions(spark).withColumn("run_id", F.lit("b")))
    tables.write_prediction_table(both, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("run_id = 'b'").count() == 2 and "PartitionFilters: [isnotnull(run_id" in (
        back.where("run_id = 'b'")._jdf.queryExecution().toString())


def test_prediction_contract(spark):
    good = predictions(spark)
    assert constraints.prediction_violations(good).isEmpty()
    with pytest.raises(ValueError, match="duplicate"):
        constraints.require_predictions(good.unionByName(good))
    with pytest.raises(ValueError, match="parse_status"):
        constraints.require_predictions(good.withColumn("parse_status", F.lit("eh")))
    with pytest.raises(ValueError, match="lacks columns"):
        constraints.require_predictions(good.drop("task"))
    with pytest.raises(ValueError, match="not a hr row"):
        constraints.require_task(good, "hr")


def ledger_file(folder, run_id, **more):
    (folder / run_id).mkdir(parents=True)
    record = {"run_id": run_id, "model": "trivial", "task": "hr", "status": "finished",
              "created_at": "2026-01-01", "updated_at": "2026-01-02", "config": {"method": "median", "train": {"lr": 1}},
              "mart_dir": None, "device": "cpu", "best_checkpoint": None, "metrics": {"n": 3, "mae": 1.5}, "error": None}
    (folder / run_id / "run.json").write_text(json.dumps({**record, **more}, indent=2))


def test_ledger_skips_broken_files(spark, tmp_path):
    ledger_file(tmp_path, "a")
    ledger_file(tmp_path, "b", status="odd", config={})
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "run.json").write_text("{ not json")
    runs = tables.read_ledger(spark, str(tmp_path / "*" / "run.json"))
    assert sorted(r["run_id"] for r in runs.select("run_id").collect()) == ["a", "b"]
    assert tables.load_run(runs, "a").select("metrics.mae").first()[0] == 1.5
    with pytest.raises(ValueError, match="no such run"):
        tables.load_run(runs, "zz")
    with pytest.raises(ValueError, match="b "):
        tables.require_ledger(runs)


def test_column_picking(spark):
    df = spark.createDataFrame([(1.0, "x", 2)], "Unix_Time DOUBLE, name STRING, Green_Raw INT")
    assert watch.pick_column(df, watch.TIME_KEYS) == "Unix_Time"
    assert watch.value_column(df, ("ppg", "green")) == "Green_Raw"
    assert watch.value_column(df, ("nothing",)) == "Green_Raw"
    with pytest.raises(ValueError, match="no value column"):
        watch.value_column(df.select("name"), ("nothing",))


@pytest.fixture
def watch_folder(tmp_path):
    base = tmp_path / "Data"
    for name, header in (("P01", "timestamp,ppg"), ("P02", "Time,green_value")):
        for sub in ("GalaxyWatch", "Polar H10"):
            (base / name / sub).mkdir(parents=True)
        wave = np.sin(2 * np.pi * 1.2 * np.arange(510) / 25)
        lines = [f"{1_700_000_000_000 + 40 * i},{'bad' if i == 300 and name == 'P02' else v}" for i, v in enumerate(wave)]
        (base / name / "GalaxyWatch" / "a_PPG_1.csv").write_text("\n".join([header, *lines]) + "\n")
        ecg = spikes(75, seconds=20.0)
        lines = [f"{1_700_000_000_000 + i * 1000 / 130},{v}" for i, v in enumerate(ecg)]
        (base / name / "Polar H10" / "ECG.csv").write_text("\n".join(["ts,ecg_mv", *lines]) + "\n")
        events = ["0,Baseline_ENTER", "10000,Walking_ENTER", "2000000,EXIT Walking"]
        (base / name / "Events.csv").write_text("\n".join(["time,event", *events]) + "\n")
    (base / "P01" / "GalaxyWatch" / "zz_PPG_2.csv").write_text("timestamp,ppg\n")
    (base / "P03" / "GalaxyWatch").mkdir(parents=True)
    (base / "P03" / "GalaxyWatch" / "PPG.csv").write_text("timestamp,ppg\n1,2\n")
    return tmp_path


def test_watch_folder_to_registry(spark, watch_folder, many_runs):
    found = {(r["subject_id"], r["kind"]): r["path"] for r in watch.discover(spark, str(watch_folder)).collect()}
    assert {s for s, _ in found} == {"P01", "P02"} and found["P01", "ppg"].endswith("a_PPG_1.csv")
    rows = {r["record_id"]: r for r in process.watch_registry(spark, str(watch_folder), "watch").collect()}
    assert set(rows) == {"P01_0000", "P01_0001", "P02_0000"}  # P02's second window has a bad sample
    assert all(r["hr_ref"] == pytest.approx(75, rel=0.03) and len(r["ppg"]) == 300 for r in rows.values())
    assert rows["P01_0000"]["activity"] == "Baseline" and rows["P01_0001"]["activity"] == "Walking"
    want = -np.sin(2 * np.pi * 1.2 * np.arange(300) / 30)
    assert np.allclose(rows["P01_0000"]["ppg"], want, atol=1e-4)
    reg = process.watch_registry(spark, str(watch_folder), "watch")
    assert {r["fold"] for r in splits.all_test_split(reg).collect()} == {"test"}


def test_watch_folder_below_a_folder_that_starts_with_p(spark, tmp_path, many_runs):
    raw = tmp_path / "Projects" / "raw"
    for name, header in (("P01", "timestamp,note,signal"), ("P02", '"note","signal"')):
        for sub, kind in (("GalaxyWatch", "PPG"), ("Polar H10", "ECG")):
            (raw / name / sub).mkdir(parents=True)
            rows = [f'{1000 * i},"a, b",{i / 2}' if "timestamp" in header else f'"a, b",{i / 2}' for i in range(30)]
            (raw / name / sub / f"{kind}.csv").write_text("\ufeff" + "\n".join([header, *rows]) + "\n")
    found = watch.discover(spark, str(raw))
    assert {(r["subject_id"], r["kind"]) for r in found.collect()} == {(s, k) for s in ("P01", "P02") for k in ("ppg", "ecg")}
    got = watch.read_signal(spark, str(raw), found, "ppg", 25.0).collect()
    assert {(r["subject_id"], r["t"], r["idx"], r["value"]) for r in got} == {
        (s, float(i) * step, i, i / 2) for s, step in (("P01", 1000.0), ("P02", 0.04)) for i in range(30)}
    (raw / "P01" / "GalaxyWatch" / "PPG.csv").write_text("note\nno number\n")
    with pytest.raises(Exception, match="no value column"):
        watch.read_signal(spark, str(raw), found, "ppg", 25.0).collect()


def test_series_without_time_column(spark, many_runs):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "subject_id STRING, n INT, ppg DOUBLE")
    got = watch.series(df, watch.VALUE_KEYS["ppg"], ["n"], fs=25.0)
    assert {(r["idx"], r["t"], r["value"]) for r in got.collect()} == {(i, i / 25.0, float(i)) for i in range(50)}


def test_event_log_without_usable_columns(spark):
    df = spark.createDataFrame([("a", 1)], "subject_id STRING, x INT")
    assert watch.event_log(df).isEmpty()


def test_reports_and_marts_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, "drop")], "model STRING, mae DOUBLE, other STRING")
    tables.write_report(df, ["mae", "model"], str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["mae", "model"] and [tuple(r) for r in back.collect()] == [("0.5", "m")]
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["mae"] == 0.5
    mart_io.write_manifest(df, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 1
