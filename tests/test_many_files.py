"""Many small files: written, put in place and listed by many tasks, whatever their bytes."""

import datetime
import uuid
from pathlib import Path

import pytest

from pulsemill.sources import named, recordings, watch
from queryset import files


@pytest.fixture
def staged(tmp_path, monkeypatch):
    """How many files each task wrote."""
    log, write = tmp_path / "log", named.NamedWriter.write
    log.mkdir()

    def noted(self, batches):
        out = write(self, batches)
        (log / uuid.uuid4().hex).write_text(str(len(out.files)))
        return out

    monkeypatch.setattr(named.NamedWriter, "write", noted)
    return lambda: [n for n in (int(p.read_text()) for p in log.iterdir()) if n]


@pytest.mark.parametrize("query", ["watch_discovery", "watch_file_series"])
def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch, staged, query):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 40, start + datetime.timedelta(seconds=i), "view", float(i)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    root = f"file://{tmp_path}/made"
    monkeypatch.setattr(files, "_fresh", lambda spark: f"{root}-{uuid.uuid4().hex}")
    got = getattr(files, query)(spark, str(tmp_path))
    assert got.count() == (3 * 26 if query == "watch_discovery" else 260)
    assert len(staged()) > 4 and sum(staged()) == 40 + 10 + 26 + 40 and max(staged()) < 40
    assert not list(Path(tmp_path).glob("made*/Projects/raw/.staged*"))


def test_no_list_of_files_is_held_by_the_driver(spark, tmp_path):
    for home in ("P1", "Data/P2", "Data/Q", "_P3", "P4/.hidden"):
        for name in ("GalaxyWatch/PPG.csv", "Polar H10/ECG.csv", "deep/er/Event.csv", "_PPG.csv", "PPG.txt"):
            path = tmp_path / home / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("ts,x\n")
    found = watch.discover(spark, f"file://{tmp_path}/")
    assert found.inputFiles() == []
    assert {tuple(r) for r in found.collect()} == {
        (s, k, f"{home}/{name}") for s, home in (("P1", "P1"), ("P2", "Data/P2"))
        for k, name in (("ppg", "GalaxyWatch/PPG.csv"), ("ecg", "Polar H10/ECG.csv"), ("event", "deep/er/Event.csv"))}
    with pytest.raises(Exception, match="missing"):
        watch.discover(spark, f"{tmp_path}/missing").collect()


def test_a_repeated_attempt_finds_its_files_in_place(tmp_path):
    writer = named.NamedWriter(str(tmp_path), "job")
    (tmp_path / ".staged-job").mkdir()
    (tmp_path / ".staged-job" / "x").write_text("1")
    for _ in range(2):
        assert writer.put(iter([("deep/a", [".staged-job/x"])])) == 1
    assert (tmp_path / "deep" / "a").read_text() == "1"
    with pytest.raises(FileNotFoundError):
        writer.put(iter([("b", [".staged-job/y"])]))


@pytest.mark.parametrize("keys", ['["signal"]', '["no such"]'])
def test_files_of_one_header_are_parsed_together(tmp_path, monkeypatch, keys):
    ranges = []
    for i in range(90):
        lines = [f"{(1 << i % 40) + j if j % 4 else ''},{'x' if i % 7 == 3 else j},{j / 2}" for j in range(i % 13)]
        text = "\n".join(["ts,kind,signal" if i < 60 else 'kind,"signal",more', *lines, "" if i % 2 else "\n"])
        (tmp_path / f"{i}.csv").write_text(text)
        ranges += [(f"P{i}", f"{i}.csv", at, min(at + 40, len(text))) for at in range(0, len(text), 40)]
    reader = recordings.SignalReader({"root": str(tmp_path), "listing": "", "time_keys": '["ts"]', "value_keys": keys})
    read = lambda some: list(reader.read(recordings.InputPartition(some)))
    rows = lambda batches: sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["subject_id"], r["block"], r["row"]))
    alone = rows(b for own in ranges for b in read([own]))
    together = read(ranges)
    assert len(together) <= 5 and rows(together) == alone
    assert sum(r["n"] or 0 for r in alone) == sum(r["row"] >= 0 for r in alone) == sum(i % 13 for i in range(90))
    monkeypatch.setattr(recordings, "CHUNK", 16)
    assert rows(read(ranges)) == alone
