"""Reports of merged partial aggregates against reports of the whole table."""

import shutil

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import metrics, partials

COLUMNS = "run_id string, record_id string, task string, y_true double, y_pred double, prob_good double, parse_status string"


def predictions(spark, n=400):
    rows = []
    for i in range(n):
        run = f"q{i % 3}"
        score = (i * 37 % 101) / 100
        rows.append((run, f"r{i}", "quality", float(i % 4 > 0), None if i % 17 == 0 else float(score >= 0.5), None if i % 19 == 0 else score, "invalid" if i % 17 == 0 else "ok"))
        rows.append(("hr", f"r{i}", "hr", 60.0 + i % 50, None if i % 23 == 0 else 61.5 + i % 47, None, None))
    rows += [("none", "a", "quality", 1.0, None, None, "invalid"), ("bare", "a", "hr", 1.0, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(df):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()], key=repr)


def test_adding_a_source_reads_only_it(spark, tmp_path):
    whole, store = predictions(spark), str(tmp_path / "store")
    part = F.pmod(F.hash("record_id"), F.lit(2))
    for i in range(2):
        whole.where(part == i).write.parquet(str(tmp_path / f"in{i}"))
    partials.add(spark.read.parquet(str(tmp_path / "in0")), store, "in/0")
    shutil.move(tmp_path / "in0", tmp_path / "away")  # the first source cannot be read again
    partials.add(spark.read.parquet(str(tmp_path / "in1")), store, "in/1")
    counts = partials.merged(spark, store)
    assert rows_of(partials.evaluate(counts)) == rows_of(metrics.evaluate(whole))
    assert rows_of(partials.threshold_curve(counts)) == rows_of(metrics.threshold_curve(whole.where("task = 'quality'")))
    assert rows_of(partials.roc_auc(counts.where("task = 'quality'"))) == rows_of(metrics.roc_auc(metrics.scored(whole.where("task = 'quality'"))))
    assert counts.count() < whole.count() / 2  # copies of a score are one row


def test_a_source_that_comes_again_replaces_itself(spark, tmp_path):
    whole, store = predictions(spark, 60), str(tmp_path / "store")
    partials.add(whole.limit(5), store, "a")
    for _ in range(2):
        partials.add(whole, store, "a")
    partials.add(whole.limit(0), store, "nothing")
    assert rows_of(partials.evaluate(partials.merged(spark, store))) == rows_of(metrics.evaluate(whole))
    with pytest.raises(ValueError):
        partials.add(whole, store, "")


def test_runs_with_two_tasks_are_an_error(spark, tmp_path):
    whole = predictions(spark, 20).withColumn("run_id", F.lit("one"))
    partials.add(whole, str(tmp_path / "store"), "a")
    with pytest.raises(Exception, match="several tasks in one run"):
        partials.evaluate(partials.merged(spark, str(tmp_path / "store"))).collect()
