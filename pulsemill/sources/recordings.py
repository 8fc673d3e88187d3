"""Signal CSVs as a Spark data source with a task per byte range.

The ranges are planned from a table of (subject_id, path) and the files' lengths: long files
are cut, short ones share a task. A task reads a file's header once, then the lines that begin
in its range, and nothing else of the file. The lines of files with the same header are parsed
together, so that a file of few lines costs little more than its lines. Besides the samples it returns one summary row per
range (row -1): how many samples the range holds, their least and greatest time, and for each
column whether it held numbers only. Places and times of whole files follow from these rows,
so no sample is sorted or moved.

Columns: subject_id, block (the range's first byte), row (place in the range), timed (whether
the file has a time column), t, value; for a file without a column of a known name, value is
null and cells has every column's number or null. Summary rows: n, t_min, t_max, and kinds (per
column: 0 all empty, 1 numbers, 2 other texts). Blank lines are skipped; a missing or bad cell is
null, as are NaN values; a text in quotes may hold commas but no line break; a file without
lines has no rows. The files must be on a file system that Arrow opens.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: bytes of a task's ranges, what opening a file counts for, bytes that are read at a time, and files whose lengths are asked for at a time
SPLIT, OPEN_COST, CHUNK, ASKED = 64 << 20, 1 << 17, 4 << 20, 10_000
_NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
SCHEMA = pa.schema([
    ("subject_id", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("timed", pa.bool_()), ("t", pa.float64()),
    ("value", pa.float64()), ("cells", pa.list_(pa.float64())), ("kinds", pa.list_(pa.int32())), ("n", pa.int64()),
    ("t_min", pa.float64()), ("t_max", pa.float64()),
])
DDL = (
    "subject_id string, block long, row long, timed boolean, t double, value double, cells array<double>, "
    "kinds array<int>, n long, t_min double, t_max double"
)


class SignalFiles(DataSource):
    """Options: ``root``, ``listing`` (a parquet table of subject_id and path below the root),
    ``time_keys`` and ``value_keys`` (JSON lists), ``split`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "pulsemill_signal_files"

    def schema(self) -> str:
        return DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return SignalReader(dict(self.options))


def place(names: Sequence[str], keys: Sequence[str]) -> int | None:
    """Place of the first name that holds the earliest key."""
    low = [n.lower() for n in names]
    return next((i for key in keys for i, n in enumerate(low) if key in n), None)


@dataclass
class Range:
    """A range's summary so far."""

    subject: str
    start: int
    kinds: np.ndarray
    n: int = 0
    low: float = np.nan
    high: float = np.nan


class SignalReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.listing = options["root"].rstrip("/"), options["listing"]
        self.time_keys, self.value_keys = json.loads(options["time_keys"]), json.loads(options["value_keys"])
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        """Lists of (subject_id, path, first byte, end), of about ``split`` bytes each."""
        fs, at = pafs.FileSystem.from_uri(self.listing)
        files = pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=["subject_id", "path"]).sort_by("path")
        fs, root = pafs.FileSystem.from_uri(self.root)
        tasks, held = [[]], 0
        for batch in files.to_batches(ASKED):
            subjects, paths = (c.to_pylist() for c in batch.columns)
            sizes = fs.get_file_info([f"{root}/{path}" for path in paths])
            for subject, path, info in zip(subjects, paths, sizes, strict=True):
                size = info.size or 0
                for start in range(0, size, self.split):
                    end = min(size, start + self.split)
                    if tasks[-1] and held + end - start > self.split:
                        tasks.append([])
                        held = 0
                    tasks[-1].append((subject, path, start, end))
                    held += end - start + min(OPEN_COST, self.split // 64)
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.root)
        names, ranges, pieces, size = [], [], [], 0
        for subject, path, start, end in partition.value:
            with fs.open_input_file(f"{root}/{path}") as source:
                own = [c.strip() for c in next(csv.reader([header(source).decode("utf-8-sig")], skipinitialspace=True), [])]
                if own != names:
                    yield from self._samples(names, pieces)
                    yield from self._summaries(names, ranges)
                    names, ranges, pieces, size = own, [], [], 0
                ranges.append(Range(subject, start, np.zeros(len(names), np.int32)))
                for text in lines(source, start, end):
                    pieces.append((ranges[-1], text))
                    size += len(text)
                    if size >= CHUNK:
                        yield from self._samples(names, pieces)
                        pieces, size = [], 0
        yield from self._samples(names, pieces)
        yield from self._summaries(names, ranges)

    def _samples(self, names: list[str], pieces: list[tuple[Range, bytes]]) -> Iterator[pa.RecordBatch]:
        """The pieces' lines, which also count in their ranges' summaries."""
        flat, first, count, of = cells_of([text for _, text in pieces])
        m = len(count)
        if not m:
            return
        at, time = place(names, self.value_keys), place(names, self.time_keys)
        lines_of = np.bincount(of, minlength=len(pieces))
        begin = np.cumsum(lines_of) - lines_of
        some = np.flatnonzero(lines_of)  # of pieces with lines
        before = np.zeros(len(pieces), np.int64)
        for i, (own, _) in enumerate(pieces):
            before[i] = own.n
            own.n += int(lines_of[i])
        column = lambda i: classed(flat, first, count, i)
        t = column(time)[0] if time is not None else pa.nulls(m, pa.float64())
        if at is not None:
            value, every = column(at)[0], pa.nulls(m, pa.list_(pa.float64()))
        else:
            found = [column(i) for i in range(len(names))]
            for i, (_, kinds) in enumerate(found):
                for piece, kind in zip(some, np.maximum.reduceat(kinds, begin[some]), strict=True):
                    own = pieces[piece][0]
                    own.kinds[i] = max(own.kinds[i], kind)
            value, every = pa.nulls(m, pa.float64()), _rows([x for x, _ in found], m)
        if time is not None:
            clock = t.to_numpy(zero_copy_only=False)  # null: NaN, which fmin and fmax leave out
            spans = zip(some, np.fmin.reduceat(clock, begin[some]), np.fmax.reduceat(clock, begin[some]), strict=True)
            for piece, low, high in spans:
                own = pieces[piece][0]
                own.low, own.high = float(np.fmin(own.low, low)), float(np.fmax(own.high, high))
        yield pa.RecordBatch.from_arrays([
            pa.array([own.subject for own, _ in pieces], pa.string()).take(pa.array(of)), pa.array(np.array([own.start for own, _ in pieces], np.int64)[of]),
            pa.array(np.arange(m) - begin[of] + before[of]), pa.repeat(time is not None, m),
            t, value, every, pa.nulls(m, SCHEMA.field("kinds").type), *(pa.nulls(m, SCHEMA.field(c).type) for c in ("n", "t_min", "t_max")),
        ], schema=SCHEMA)

    def _summaries(self, names: list[str], ranges: list[Range]) -> Iterator[pa.RecordBatch]:
        timed, known = place(names, self.time_keys) is not None, place(names, self.value_keys) is not None
        yield pa.RecordBatch.from_pylist([{
            "subject_id": own.subject, "block": own.start, "row": -1, "timed": timed, "kinds": None if known else own.kinds.tolist(), "n": own.n,
            "t_min": None if np.isnan(own.low) else own.low, "t_max": None if np.isnan(own.high) else own.high,
        } for own in ranges], schema=SCHEMA)


def header(source: pa.NativeFile) -> bytes:
    """The first line."""
    source.seek(0)
    out = b""
    while b"\n" not in out and (some := source.read(1 << 16)):
        out += some
    return out.partition(b"\n")[0].rstrip(b"\r")


def lines(source: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Whole lines that begin in the bytes from ``start`` to ``end``, some at a time, without the file's first."""
    at = max(0, start - 1)
    source.seek(at)
    held, skip = b"", True  # a line that began before, or the header
    while True:
        some = source.read(CHUNK)
        held += some
        if skip:
            cut = held.find(b"\n") + 1
            if not cut and some:
                continue
            at, held, skip = at + (cut or len(held)), held[cut or len(held) :], False
        if at >= end:
            return
        if at + len(held) >= end:
            cut = held.find(b"\n", end - 1 - at) + 1
            if cut or not some:
                yield held[: cut or len(held)]
                return
        elif not some:
            yield held
            return
        elif cut := held.rfind(b"\n") + 1:
            yield held[:cut]
            at, held = at + cut, held[cut:]


def cells(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cells of lines one after the other, and for each line that is not blank its first cell and their number."""
    return cells_of([text])[:3]


def cells_of(texts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`cells` for some texts, and for each line the place of its text."""
    parted = pc.split_pattern(pa.array([text.decode(errors="replace") for text in texts], pa.large_string()), "\n")
    rows = parted.flatten()
    fill = pc.not_equal(pc.utf8_trim_whitespace(rows), "")
    rows, of = rows.filter(fill), pc.list_parent_indices(parted).filter(fill).to_numpy(zero_copy_only=False)
    quoted = pc.match_substring(rows, '"')
    if pc.any(quoted).as_py():
        parted = [[c.strip() for c in next(csv.reader([r], skipinitialspace=True))] if '"' in r else [c.strip() for c in r.split(",")] for r in rows.to_pylist()]
        split = pa.array(parted, pa.large_list(pa.large_string()))
        flat = split.flatten()
    else:
        split = pc.split_pattern(rows, ",")
        flat = pc.utf8_trim_whitespace(split.flatten())
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.cumsum(count) - count, count, of


def numbers(flat: pa.Array, first: np.ndarray, count: np.ndarray, i: int) -> tuple[pa.Array, int]:
    """Numbers of the i-th column, null where there is none, and 0, 1 or 2 for empty, numbers, other texts."""
    out, kinds = classed(flat, first, count, i)
    return out, int(kinds.max(initial=0))


def classed(flat: pa.Array, first: np.ndarray, count: np.ndarray, i: int) -> tuple[pa.Array, np.ndarray]:
    """As :func:`numbers`, with 0, 1 or 2 for each line."""
    there = i < count
    own = flat.take(pa.array(np.where(there, first + i, 0))) if len(flat) else pa.nulls(len(count), pa.large_string())
    own = pc.if_else(pa.array(there), own, "")
    fine = pc.match_substring_regex(own, _NUMBER)
    plain = pc.replace_substring_regex(pc.if_else(fine, own, None), r"^\+", "")
    out = pc.cast(plain, pa.float64())
    kinds = pc.if_else(fine, 1, pc.if_else(pc.equal(own, ""), 0, 2)).to_numpy(zero_copy_only=False).astype(np.int32)
    return pc.if_else(pc.is_nan(out), None, out), kinds


def _rows(columns: list[pa.Array], n: int) -> pa.Array:
    """One list per row from one array per column."""
    k = len(columns)
    flat = pa.concat_arrays(columns) if columns else pa.nulls(0, pa.float64())
    turn = np.arange(n * k).reshape(k, n).T.ravel() if k else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)), flat.take(pa.array(turn)))


def read_ranges(spark: SparkSession, root: str, listing: str, time_keys: Sequence[str], value_keys: Sequence[str], split: int = SPLIT) -> DataFrame:
    """Samples and summaries of the files that the parquet table ``listing`` names."""
    spark.dataSource.register(SignalFiles)
    options = {"root": root, "listing": listing, "time_keys": json.dumps(list(time_keys)), "value_keys": json.dumps(list(value_keys)), "split": str(split)}
    return spark.read.format(SignalFiles.name()).options(**options).load()
