"""Labels by state and windows by watermark against their batch forms."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import windows
from pulsemill.streaming import windows as stream


@pytest.fixture
def run(spark, tmp_path):
    """Give batches of rows to a stream, a file each; returns all rows that came out."""

    def run_(make, schema, batches, out):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = (
                make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
                .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()  # a new query each time: state comes from the checkpoint
        return spark.read.schema(out).parquet(str(tmp_path / "out")).collect()

    return run_


def test_labels_by_state(spark, run):
    log, win, end = stream.LOG, stream.WINDOW, stream.END
    batches = [
        [("a", win, 5.0, None, "w5"), ("a", log, 4.0, "walk", None), ("a", win, 1.0, None, "w1"), ("b", win, 2.0, None, "b2"), ("a", log, 5.0, "rest", None), ("a", log, 5.0, "run", None)],
        [("a", win, 30.0, None, "w30"), ("a", log, 12.0, None, None), ("a", win, 14.0, None, "w14"), ("b", log, 1.0, "walk", None)],
        [("a", log, 3.0, "swim", "e3"), ("a", win, 2.0, None, "w2"), ("a", log, 29.0, "sit", None), ("a", win, 29.0, None, "w29")],
        [("a", end, None, None, None), ("b", end, None, None, None), ("c", end, None, None, None)],
        [("a", win, 31.0, None, "w31"), ("a", end, None, None, None), ("a", win, 8.0, None, "w8")],
    ]
    got = run(lambda rows: stream.labelled(rows, delay=10.0), stream.INPUT, batches, stream.OUTPUT)
    found = {r["id"]: (r["label"], r["late"]) for r in got}
    assert found == {
        "w1": ("unknown", False), "w5": ("run", False), "w14": ("run", False), "w29": ("sit", False), "w30": ("sit", False), "w31": ("sit", False),
        "b2": ("walk", False), "e3": ("swim", True), "w2": (None, True), "w8": (None, True),
    }
    assert len(got) == len(found)


def test_labels_by_state_are_those_of_the_batch_form(spark, run):
    import random

    draw = random.Random(4)
    marks = [(draw.choice("ab"), draw.randrange(400) / 4, draw.choice(["x", "y", "z"])) for _ in range(150)]
    starts = [(draw.choice("abc"), draw.randrange(400) / 4, f"w{i}") for i in range(300)]
    rows = [(s, stream.LOG, t, label, None) for s, t, label in marks] + [(s, stream.WINDOW, t, None, w) for s, t, w in starts]
    rows.sort(key=lambda r: r[2] + draw.random() * 9)  # out of order by less than the delay
    batches = [rows[i : i + 120] for i in range(0, len(rows), 120)] + [[(s, stream.END, None, None, None) for s in "abc"]]
    got = run(lambda r: stream.labelled(r, delay=9.0), stream.INPUT, batches, stream.OUTPUT)
    want = windows.label_as_of(
        spark.createDataFrame(starts, "subject_id string, t0 double, id string"), spark.createDataFrame(marks, "subject_id string, t double, activity string"),
        ["subject_id"], "t0", "t", "activity",
    )
    assert {(r["id"], r["label"]) for r in got} == {(r["id"], r["activity"]) for r in want.collect()} and not any(r["late"] for r in got)


def test_an_idle_subject_is_closed(spark, tmp_path):
    rows = [("a", stream.LOG, 4.0, "walk", None), ("a", stream.WINDOW, 5.0, None, "w5")]
    spark.createDataFrame(rows, stream.INPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(stream.INPUT).parquet(str(tmp_path / "in"))
    query = stream.labelled(files, delay=10.0, idle=500).writeStream.format("memory").queryName("idle").trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 90
        while not (got := spark.table("idle").collect()) and time.monotonic() < until:
            time.sleep(0.5)
        assert [(r["id"], r["label"], r["late"]) for r in got] == [("w5", "walk", False)]
    finally:
        query.stop()


def test_windows_by_watermark(spark, run):
    start = datetime.datetime(2024, 1, 1)
    row = lambda s, i, v: (s, start + datetime.timedelta(seconds=i), v)
    batches = [
        [row("a", i, float(i)) for i in (3, 1, 0, 2)] + [row("b", i, 1.0) for i in range(3)],
        [row("a", i, float(i)) for i in (4, 5, 7, 100)],
        [row("b", 3, 1.0), row("a", 6, 6.0), row("a", 101, 1.0)],  # too late for two windows
        [row("end", 10_000, None)],
    ]
    make = lambda rows: stream.timed(rows, 4.0, 1.0, "20 seconds")
    got = run(make, "subject_id string, ts timestamp, value double", batches, "subject_id string, window_idx long, x array<double>")
    first = int((start - datetime.datetime(1970, 1, 1)).total_seconds()) // 4
    assert [(r["subject_id"], r["window_idx"], r["x"]) for r in got] == [("a", first, [0.0, 1.0, 2.0, 3.0])]
