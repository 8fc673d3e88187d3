"""The participant files of the watch queries: whole, in order, and no user's events in one row."""

import datetime
from pathlib import Path

import pytest

from queryset import files

USERS = (1, 2, 3, 4)


@pytest.fixture
def events(spark, tmp_path, monkeypatch):
    """Events of which user 4 has most, with equal times whose order only event_id tells."""
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (i, user, start + datetime.timedelta(milliseconds=i // 3), ("view", "click", "buy")[i % 3], float(i))
        for user in USERS for i in range(user * 1000, user * 1000 + (900 if user == 4 else 30))
    ]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    made = []
    monkeypatch.setattr(files, "_fresh", lambda spark: made.append(f"file://{tmp_path}/made{len(made)}") or made[-1])
    return str(tmp_path), rows


def csvs(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).glob("made*/Projects/raw/**/*.csv")}


def test_discovery_writes_headers_only(spark, events):
    sf, _ = events
    found = files.watch_discovery(spark, sf).collect()
    assert {r["subject_id"] for r in found} == {"P1", "P2", "P4"} and len(found) == 9
    assert set(csvs(sf).values()) == {"timestamp,kind,signal\n"}


def test_files_hold_all_lines_in_order_from_many_tasks(spark, events, many_runs, monkeypatch):
    sf, rows = events
    monkeypatch.setattr(files, "COPIED", 50)
    got = files.watch_file_series(spark, sf).collect()
    for user in (1, 2, 4):
        own = [r[4] for r in rows if r[1] == user]
        assert [r["value"] for r in sorted((r for r in got if r["subject_id"] == f"P{user}"), key=lambda r: r["idx"])] == own
    written = csvs(sf)
    assert len(written) == 4 + 1 + 3 + 4
    for name, text in written.items():
        user = int(name.partition("P")[2].split("P")[1].split("/")[0])
        lines = text.splitlines()
        assert lines[0] == "timestamp,kind,signal" and [float(x.split(",")[2]) for x in lines[1:]] == [r[4] for r in rows if r[1] == user]
    pieces = [p.read_text().splitlines() for p in Path(sf).glob("made*/*") if p.is_file()]
    assert sum(any(float(x.split(",")[2]) >= 4000 for x in lines) for lines in pieces) > 1
