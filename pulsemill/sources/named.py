"""Files under names of one's own, written by many tasks and put in place by many tasks.

Rows (name, content) go to the file ``name`` below a folder, in the order of the partitions and
of the rows in them. A task writes below ``.staged-<job>`` under names that no other attempt
has, and lists them as rows, so only the files of the attempts that count are known. When all
are written, a second job deals the names over tasks, which move whole files to their names. A
file that several tasks wrote is joined first, its parts in order, a piece of ``COPIED`` bytes at
a time. So a reader never sees a file that is half written, no list of files passes through the
driver, and what a lost or repeated attempt wrote is deleted with the staging folder, as is all
of it if the first job fails. Files of other names stay as they are; an empty table writes nothing.

Null names are an error; a null content is an empty one; names may hold folders but not leave
the folder.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes that are copied at a time, names in a batch, and names that are worth a task
COPIED, ROWS, ROWS_A_TASK = 4 << 20, 10_000, 200


@dataclass
class Written:
    """What a task wrote: its partition, and (name, staged file) in the order of the rows."""

    part: int
    files: list[tuple[str, str]]


class NamedWriter:
    """One job's files: ``write`` stages a task's rows, ``put`` or ``commit`` gives files their names."""

    def __init__(self, folder: str, job: str):
        self.folder = folder.rstrip("/")
        self.staged = f".staged-{job}"

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = self._open()
        files: list[tuple[str, str]] = []
        out = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    if name is None or name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"no name for a file: {name!r}")
                    if not files or name != files[-1][0]:
                        if out:
                            out.close()
                        if not files:
                            fs.create_dir(f"{root}/{self.staged}", recursive=True)
                        files.append((name, f"{self.staged}/{uuid.uuid4().hex}"))
                        out = fs.open_output_stream(f"{root}/{files[-1][1]}")
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out:
                out.close()
        return Written(TaskContext.get().partitionId(), files)

    def put(self, names: Iterator[tuple[str, list[str]]]) -> int:
        """Move staged files to their names; those that an earlier attempt has moved are left. Returns how many there are."""
        fs, root = self._open()
        made, n = set(), 0
        for name, staged in names:
            home = name.rpartition("/")[0]
            if home not in made:
                fs.create_dir(f"{root}/{home}", recursive=True)
                made.add(home)
            whole = f"{root}/{staged[0]}"
            if len(staged) > 1:
                whole = _joined(fs, [f"{root}/{x}" for x in staged], f"{root}/{self.staged}/{uuid.uuid4().hex}")
            try:
                fs.move(whole, f"{root}/{name}")  # replaces a file of that name
            except FileNotFoundError:
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise
            n += 1
        return n

    def commit(self, messages: list[Written | None]) -> None:
        parts: dict[str, list[str]] = {}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for name, staged in message.files:
                parts.setdefault(name, []).append(staged)
        self.put(iter(parts.items()))
        self.clear()

    def clear(self) -> None:
        fs, root = self._open()
        if fs.get_file_info(f"{root}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staged}")


def _joined(fs: pafs.FileSystem, parts: list[str], path: str) -> str:
    with fs.open_output_stream(path) as out:
        for part in parts:
            with fs.open_input_stream(part) as source:
                while some := source.read(COPIED):
                    out.write(some)
    return path


def write_named(files: DataFrame, folder: str, whole: bool = False) -> None:
    """Write (name, content) rows below ``folder``; contents are texts or bytes.

    With ``whole`` each row is a file of its own, and the rows are dealt over the tasks by name,
    however few bytes they have: a file costs more than its bytes.
    """
    spark = files.sparkSession
    most = 4 * spark.sparkContext.defaultParallelism
    writer = NamedWriter(folder, uuid.uuid4().hex)
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    if whole:
        rows = rows.repartition(most, "name")  # a number of one's own, which adaptive execution keeps

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = writer.write(batches)
        for at in range(0, len(done.files), ROWS):
            names, staged = zip(*done.files[at : at + ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([done.part] * len(names), pa.int32()), pa.array(range(at, at + len(names)), pa.int64()), pa.array(staged)],
                names=["name", "part", "place", "staged"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ((r["name"], r["staged"]) for batch in batches for r in batch.to_pylist())
        n = writer.put((name, [staged for _, staged in group]) for name, group in itertools.groupby(own, lambda r: r[0]))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    base = writer.folder if ":" in writer.folder.split("/")[0] else f"file://{writer.folder}"
    listed = f"{base}/{writer.staged}/listed"
    schema = "name string, part int, place long, staged string"
    try:
        rows.mapInArrow(stage, schema).write.parquet(listed)
        staged = spark.read.schema(schema).parquet(listed)
        tasks = min(most, staged.count() // ROWS_A_TASK + 1)
        staged.repartition(tasks, "name").sortWithinPartitions("name", "part", "place").mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()
    finally:
        writer.clear()


def write_single(lines: DataFrame, path: str, first: Column | None = None) -> None:
    """Write the text column ``line`` as the one file ``path``, in the order of ``lines``, below the line ``first``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if first is not None:
        lines = lines.sparkSession.range(1, numPartitions=1).select(first.alias("line")).union(lines.select("line"))
    write_named(lines.select(F.lit(name).alias("name"), F.concat("line", F.lit("\n")).alias("content")), folder or ".")
