"""ECG files on the PPG grid: one Python pass per task, on a bounded number of samples at a time."""

import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsemill.sources import signals
from queryset import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_decoded_and_resampled_by_one_worker(spark, tmp_path):
    spark.createDataFrame([(1, [0.5] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = files.ecg_on_grid(spark, str(tmp_path))
    assert plan(got).count("ArrowEvalPython") == 1 and plan(got).count("MapInArrow") == 1
    assert sorted(tuple(r) for r in got.collect()) == [("1", 0, 0.5), ("1", 1, 0.5), ("2", 0, 1.0), ("2", 1, 1.0)]


def test_an_explode_does_not_resample_again(spark):
    rows = spark.createDataFrame([("a", [2.0] * 100, 1), ("b", None, 2), ("c", [], 3)], "record_id string, x array<float>, other int")
    grid = signals.ecg_on_ppg_grid(rows)
    assert {r["record_id"]: r["ecg"] for r in grid.collect()} == {"a": [2.0] * 3, "b": None, "c": None}
    cells = grid.select("record_id", F.posexplode("ecg"))
    assert plan(cells).count("ArrowEvalPython") == 0 and plan(cells).count("MapInArrow") == 1
    assert cells.count() == 3


def test_bad_files_are_rows_without_samples(spark):
    buffer = io.BytesIO()
    np.save(buffer, np.full((100, 1), 3.0))
    rows = spark.createDataFrame([("/raw/1.npy", bytearray(buffer.getvalue())), ("/raw/2.npy", bytearray(b"no")), ("/raw/3.npy", None)], "path string, content binary")
    got = {r["record_id"]: (r["ecg"], r["reject_reason"] is None) for r in signals.ecg_files_on_grid(rows).collect()}
    assert got == {"1": ([3.0] * 3, True), "2": (None, False), "3": (None, False)}


@pytest.mark.parametrize("most", [1, 350, 10**6])
def test_long_windows_are_taken_some_at_a_time(monkeypatch, most):
    draw = np.random.default_rng(1)
    x = [draw.normal(size=n).tolist() if n else None for n in (100, 0, 200, 100, 12000, 100)]
    batch = pa.RecordBatch.from_pydict({"record_id": list("abcdef"), "x": pa.array(x, pa.list_(pa.float32()))})
    whole = list(signals._resampling("x")(iter([batch])))
    monkeypatch.setattr(signals, "SAMPLES", most)
    parts = list(signals._resampling("x")(iter([batch])))
    assert len(parts) == {1: 6, 350: 4, 10**6: 1}[most] if most > 1 else len(parts) >= 5
    assert [r for b in parts for r in b.to_pylist()] == [r for b in whole for r in b.to_pylist()]
    assert [len(r) if r else 0 for b in whole for r in b.column("ecg").to_pylist()] == [3, 0, 6, 3, 300, 3]
