"""Named files with a commit, and signal files read by ranges."""

import io
import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsemill.sources import named, recordings, tables, watch


def below(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_of_many_tasks_are_joined_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named, "COPIED", 3)
    rows = spark.range(0, 1000, numPartitions=7)
    name = F.when(F.col("id") < 100, "a.txt").when(F.col("id") < 900, "deep/er/b.txt").otherwise(F.concat(F.lit("c"), F.col("id").cast("string")))
    named.write_named(rows.select(name.alias("name"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content")), str(tmp_path / "out"))
    got = below(tmp_path / "out")
    assert got.pop("a.txt") == "".join(f"{i}\n" for i in range(100))
    assert got.pop("deep/er/b.txt") == "".join(f"{i}\n" for i in range(100, 900))
    assert got == {f"c{i}": f"{i}\n" for i in range(900, 1000)}


def test_files_are_replaced_whole_and_others_stay(spark, tmp_path):
    for rows in ([("x", "one"), ("y", None)], [("x", "two")]):
        named.write_named(spark.createDataFrame(rows, "name string, content string"), f"file://{tmp_path}/out")
    assert below(tmp_path / "out") == {"x": "two", "y": ""}
    named.write_named(spark.createDataFrame([], "name string, content string"), str(tmp_path / "out"))
    assert below(tmp_path / "out") == {"x": "two", "y": ""}


@pytest.mark.parametrize("bad", [None, "/root/x", "../x"])
def test_a_failed_job_leaves_what_was_there(spark, tmp_path, bad):
    named.write_named(spark.createDataFrame([("x", "one")], "name string, content string"), str(tmp_path / "out"))
    rows = spark.createDataFrame([("x", "two"), ("z", "new"), (bad, "?")], "name string, content string").repartition(3)
    with pytest.raises(Exception, match="no name for a file"):
        named.write_named(rows, str(tmp_path / "out"))
    assert below(tmp_path / "out") == {"x": "one"}


def test_attempts_that_do_not_count_leave_nothing(tmp_path, monkeypatch):
    """Three attempts of one task, the first of which was killed half-way: only the message's files are put in place."""
    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr(named.TaskContext, "get", staticmethod(Context))
    writer = named.NamedWriter(str(tmp_path), "job")
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a", "b"], "content": [b"1", b"2", b"3"]})

    def killed():
        yield batch
        raise RuntimeError("lost executor")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    late, counts = writer.write(iter([batch])), writer.write(iter([batch]))
    assert not (tmp_path / "a").exists() and late.files != counts.files
    writer.commit([counts, None])
    assert below(tmp_path) == {"a": "12", "b": "3"}


def test_reports_are_single_files(spark, tmp_path):
    df = spark.range(50, numPartitions=5).select("id", F.concat(F.lit('a "b", '), "id").alias("text"), F.lit(None).cast("double").alias("none"))
    tables.write_report(df, ["text", "id"], str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").is_file()
    back = spark.read.csv(str(tmp_path / "r.csv"), header=True, escape='"')
    assert [tuple(r) for r in back.collect()] == [(f'a "b", {i}', str(i)) for i in range(50)]
    tables.write_json(df.where("id = 7"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"id": 7, "text": 'a "b", 7'}


# -- ranges ----------------------------------------------------------------------------


def test_every_line_is_in_one_range(monkeypatch):
    text = ("time,ppg\n" + "".join(f"{i},{'x' * (i % 13)}\n" + "\n" * (i % 5 == 0) for i in range(60)) + "last,1").encode()
    want = [x for x in text.decode().split("\n")[1:] if x]
    for chunk in (1, 7, 4096):
        monkeypatch.setattr(recordings, "CHUNK", chunk)
        for split in (1, 2, 9, 10, 64, len(text)):
            got = []
            for start in range(0, len(text), split):
                source = pa.PythonFile(io.BytesIO(text), "r")
                for part in recordings.lines(source, start, min(len(text), start + split)):
                    got += [x for x in part.decode().split("\n") if x]
            assert got == want


def test_cells_are_those_of_the_lines():
    flat, first, count = recordings.cells(b'1, 2,x\r\n\n"a, b",3\n  \n4\n+5,NaN,-inf\n')
    rows = [flat.to_pylist()[a : a + n] for a, n in zip(first, count)]
    assert rows == [["1", "2", "x"], ["a, b", "3"], ["4"], ["+5", "NaN", "-inf"]]
    column = lambda i: [x.to_pylist() if hasattr(x, "to_pylist") else x for x in recordings.numbers(flat, first, count, i)]
    assert column(0) == [[1.0, None, 4.0, 5.0], 2]
    assert column(1) == [[2.0, 3.0, None, None], 1]
    assert column(2) == [[None, None, None, float("-inf")], 2]
    assert column(3) == [[None] * 4, 0]


def test_ranges_give_the_series(spark, tmp_path):
    home = tmp_path / "P1" / "GalaxyWatch"
    home.mkdir(parents=True)
    (tmp_path / "P1" / "Polar H10").mkdir()
    (tmp_path / "P1" / "Polar H10" / "ECG.csv").write_text("ts,ecg\n")
    for header, time in (("\ufeffclock ts,note,signal", True), ("rest,note,signal", False)):
        rows = [f"{5000 + 100 * i if time else 'x'},n{i},{'' if i % 9 == 4 else i / 2}" for i in range(3000)]
        (home / "PPG.csv").write_text("\n".join([header, *rows]))
        found = watch.discover(spark, str(tmp_path))
        got = watch.read_signal(spark, str(tmp_path), found, "ppg", 25.0, split=1000).collect()
        assert sorted((r["idx"], r["t"], r["value"] if r["value"] is not None else -1.0) for r in got) == [
            (i, i * 100.0 if time else i / 25.0, -1.0 if i % 9 == 4 else i / 2) for i in range(3000)]
    read = recordings.SignalReader({"root": str(tmp_path), "listing": str(tmp_path / "listing"), "time_keys": "[]", "value_keys": "[]", "split": "1000"})
    spark.createDataFrame([("P1", "P1/GalaxyWatch/PPG.csv"), ("P1", "P1/Polar H10/ECG.csv")], "subject_id string, path string").write.parquet(str(tmp_path / "listing"))
    tasks = [p.value for p in read.partitions()]
    size = (home / "PPG.csv").stat().st_size
    assert len(tasks) > size // 1000 and sorted(r[2] for t in tasks for r in t if "PPG" in r[1]) == list(range(0, size, 1000))
