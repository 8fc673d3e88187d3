"""Watch and chest-strap CSVs: irregular headers, one folder per participant."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill.functions.labels import event_name
from pulsemill.operators.scale import dense_index, join_dimension
from pulsemill.session import materialize, shared_folder
from pulsemill.sources import recordings

# fixed values: column keys looked for in this order, folder patterns, sampling rates
TIME_KEYS = ("timestamp", "time", "unix", "ts")
VALUE_KEYS = {"ppg": ("ppg", "green", "value"), "ecg": ("ecg", "value", "mv")}
HOME_FOLDERS = {
    "ppg": "^GalaxyWatch/[^/]+$", "ecg": "^Polar(%20| )H10/[^/]+$", "event": "^[^/]+$",
}
EVENT_KEYS = ("event", "session", "status", "activity", "marker")
PPG_FS, ECG_FS = 25.0, 130.0


def pick_column(df: DataFrame, keys: Sequence[str]) -> str | None:
    """The first column whose lower-case name holds the earliest key."""
    return next((c for key in keys for c in df.columns if key in c.lower()), None)


def value_column(df: DataFrame, keys: Sequence[str]) -> str:
    """As :func:`pick_column`, else the last numeric column."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    found = pick_column(df, keys) or (numeric[-1] if numeric else None)
    if found is None:
        raise ValueError(f"no value column among {df.columns}")
    return found


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(F.col(name).cast("timestamp")).cast("double")
    value = F.col(name).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def relative_time(df: DataFrame, time: Column, key: str = "subject_id") -> DataFrame:
    """Add ``t``: seconds since the series' first sample. Spans above 1e6 are milliseconds.

    First and last times are aggregated per series and joined back, so no series
    has to pass through one task.
    """
    timed = df.withColumn("t", time)
    span = timed.groupBy(key).agg(F.min("t").alias("span_min"), F.max("t").alias("span_max"))
    return _since_start(join_dimension(timed, span, key, "left"))


def _since_start(timed: DataFrame) -> DataFrame:
    """Rescale ``t`` by the series' ``span_min`` and ``span_max``."""
    scale = F.when(F.col("span_max") - F.col("span_min") > 1e6, 1000.0).otherwise(1.0)
    seconds = (F.col("t") - F.col("span_min")) / scale
    return timed.withColumn("t", seconds).drop("span_min", "span_max")


def series(
    df: DataFrame,
    value_keys: Sequence[str],
    order: Sequence[str],
    fs: float = PPG_FS,
    key: str = "subject_id",
) -> DataFrame:
    """(subject_id, t, idx, value) of a signal table with unknown column names.

    ``order`` gives the sample order, ending in a tie-breaker. Without a time
    column, t is the position at ``fs``. Bad values become null.
    """
    time, value = pick_column(df, TIME_KEYS), value_column(df, value_keys)
    base = df.select(
        F.col(key).cast("string").alias("subject_id"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        _number(df, value).alias("value"),
        (_number(df, time) if time else F.lit(None).cast("double")).alias("t"),
    )
    places = [f"_o{i}" for i in range(len(order))]
    placed = dense_index(base, ["subject_id"], places, span_of="t" if time else None)
    if time is None:
        placed = placed.withColumn("t", F.col("idx") / F.lit(fs))
    else:
        placed = _since_start(placed)
    return placed.select("subject_id", "t", "idx", "value")


def event_log(df: DataFrame, name: str | None = None, keep_exits: bool = True,
              key: str = "subject_id") -> DataFrame:
    """(subject_id, t, activity) from an event table.

    By default an EXIT marker is a log entry of its activity like any other.
    """
    time = pick_column(df, TIME_KEYS)
    name = name or pick_column(df.drop(key, *([time] if time else [])), EVENT_KEYS)
    if time is None or name is None:
        return df.sparkSession.createDataFrame([], "subject_id STRING, t DOUBLE, activity STRING")
    rows = df if keep_exits else df.where(~F.upper(name).contains("EXIT"))
    named = rows.select(
        F.col(key).cast("string").alias("subject_id"),
        _number(rows, time).alias("_time"),
        event_name(F.col(name)).alias("activity"),
    )
    return (
        relative_time(named, F.col("_time"))
        .where("activity IS NOT NULL")
        .select("subject_id", "t", "activity")
    )


def _below(path: Column, root: str) -> Column:
    """The part of a file's address below the folder ``root``."""
    plain = F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "%20", " ")
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    return F.substring(plain, F.lit(len(bare) + 1), F.length(plain))


def _csv_names(spark: SparkSession, raw: str) -> DataFrame:
    """(path): the CSVs of the participants, listed by folder on executors; names that begin with . or _ are left out.

    One task reads the names of the participants' folders, many list what lies in them.
    """
    raw = raw.rstrip("/")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(raw)
        for below in (row["below"] for batch in batches for row in batch.to_pylist()):
            found = fs.get_file_info(pafs.FileSelector(f"{root}/{below}".rstrip("/"), allow_not_found=below != ""))
            names = [below + f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("P")]
            yield pa.RecordBatch.from_pydict({"home": pa.array(names, pa.string())})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(raw)
        for batch in batches:
            names = []
            for home in batch.column("home").to_pylist():
                for f in fs.get_file_info(pafs.FileSelector(f"{root}/{home}", recursive=True)):
                    if f.type == pafs.FileType.File and f.extension == "csv":
                        name = home + f.path.partition(f"{root}/{home}")[2]
                        if not any(part[:1] in "._" for part in name.split("/")):
                            names.append(name)
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    tops = spark.createDataFrame([("",), ("Data/",)], "below string").coalesce(1)
    # a number of tasks of one's own, which adaptive execution keeps: a name is few bytes but stands for a folder
    dealt = tops.mapInArrow(homes, "home string").repartition(4 * spark.sparkContext.defaultParallelism, "home")
    return dealt.mapInArrow(files, "path string")


def discover(spark: SparkSession, raw: str) -> DataFrame:
    """(subject_id, kind, path): the first matching CSV of each participant and kind.

    Participants are the folders P* in ``raw`` or in its folder Data; ``path`` is below
    ``raw``. A file in the kind's own folder wins over one found deeper. Participants
    without both PPG and ECG are left out. ``raw`` must be on a file system that Arrow opens.
    """
    path = F.col("path")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    kind = (
        F.when(name.contains("PPG"), "ppg").when(name.contains("ECG"), "ecg")
        .when(name.contains("Event"), "event")
    )
    inside = F.regexp_extract(path, r"^(?:Data/)?P[^/]*/(.*)$", 1)
    home = F.lit(False)
    for name_of_kind, pattern in HOME_FOLDERS.items():
        home = home | ((kind == name_of_kind) & inside.rlike(pattern))
    files = (
        _csv_names(spark, raw)
        .withColumn("kind", kind)
        .withColumn("subject_id", F.regexp_extract(path, r"^(?:Data/)?(P[^/]*)/", 1))
        .where("kind IS NOT NULL AND subject_id <> ''")
    )
    best = F.struct((~home).alias("nested"), "path")
    kinds = ("ppg", "ecg", "event")
    first = files.groupBy("subject_id").agg(*[F.min(F.when(F.col("kind") == k, best)).alias(k) for k in kinds])
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.path").alias("path")) for k in kinds]))
    complete = first.where("ppg IS NOT NULL AND ecg IS NOT NULL").select("subject_id", found.alias("file"))
    return complete.select("subject_id", "file.*").where("path IS NOT NULL")


def read_cells(spark: SparkSession, raw: str, found: DataFrame, kind: str) -> DataFrame:
    """(subject_id, block, row, names, cells): the lines of one kind's files as arrays of texts.

    Releases name and order their columns differently, so every line carries its file's
    column names. The files are read by one glob; which of them count, and their headers,
    come by joins on the path, not through the driver.
    """
    wanted = found.where(F.col("kind") == kind).select("subject_id", "path")
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(raw)
        .select(
            _below(F.col("_metadata.file_path"), raw).alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        )
    )
    lines = join_dimension(lines, wanted, "path")
    headers = lines.where("block = 0").groupBy("path").agg(
        F.min(F.struct("row", "value")).alias("head")
    ).select("path", F.col("head.row").alias("head_row"), F.col("head.value").alias("header"))

    def split(line: Column) -> Column:
        """Cells, with quotes around them taken off; a comma inside quotes does not part cells."""
        parts = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
        return F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r'^\s*"|"\s*$', "")))

    body = join_dimension(lines, headers, "path").where("row <> head_row AND trim(value) <> ''")
    return body.select(
        "subject_id", "block", "row", split(F.regexp_replace("header", "^\ufeff", "")).alias("names"), split(F.col("value")).alias("cells")
    )


def _place(names: Column, keys: Sequence[str]) -> Column:
    """Zero-based place of the first name that holds the earliest key, or null."""
    low = F.transform(names, F.lower)

    def first(key: str) -> Column:
        return F.array_position(F.transform(low, lambda n: n.contains(key)), True)

    at = [first(key) for key in keys]
    return F.coalesce(*[F.when(a > 0, a - 1) for a in at]).cast("int")


def read_signal(spark: SparkSession, raw: str, found: DataFrame, kind: str, fs: float, split: int = recordings.SPLIT) -> DataFrame:
    """The (subject_id, t, idx, value) series of every participant for one kind.

    A file without a column of a known name gives its last numeric one (numbers or empty cells,
    and not all empty), and is an error without that; a file without a time column counts time
    at ``fs``. Each byte of the files is read once, by ranges of ``split`` bytes; places and
    times follow from one summary row per range.
    """
    listing = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    found.where(F.col("kind") == kind).select("subject_id", "path").write.parquet(listing)
    read = materialize(recordings.read_ranges(spark, raw, listing, TIME_KEYS, VALUE_KEYS[kind], split))
    ranges = materialize(read.where("row < 0").select("subject_id", "block", "n", "t_min", "t_max", "kinds"))
    whole = Window.partitionBy("subject_id")  # a row per range
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    columns = ranges.select("subject_id", F.posexplode("kinds").alias("at", "is")).groupBy("subject_id", "at").agg(F.max("is").alias("is"))
    numeric = columns.where(F.col("is") == 1).groupBy("subject_id").agg(F.max("at").alias("numeric"))
    placed = ranges.select(
        "subject_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.min("t_min").over(whole).alias("span_min"), F.max("t_max").over(whole).alias("span_max"),
    )
    placed = materialize(placed.join(numeric, "subject_id", "left"))  # written, so that its size decides how it is joined
    rows = read.where("row >= 0").select("subject_id", "block", "row", "timed", "t", "value", "cells").join(placed, ["subject_id", "block"])
    error = F.raise_error(F.concat(F.lit("no value column in the file of "), F.col("subject_id"))).cast("double")
    value = F.when(F.col("cells").isNull(), F.col("value")).when(F.col("numeric").isNull(), error).otherwise(F.get("cells", F.col("numeric")))
    rows = rows.withColumns({"value": value, "idx": F.col("first") + F.col("row")})
    by_clock = _since_start(rows).withColumn("t", F.when(F.col("timed"), F.col("t")).otherwise(F.col("idx") / F.lit(fs)))
    return by_clock.select("subject_id", "t", "idx", "value")


def read_events(spark: SparkSession, raw: str, found: DataFrame, keep_exits: bool = True) -> DataFrame:
    """(subject_id, t, activity) of every participant with an event file that has the columns."""
    cells = read_cells(spark, raw, found, "event")
    time = _place(F.col("names"), TIME_KEYS)
    others = F.transform(F.col("names"), lambda n, i: F.when(i == F.col("time"), "").otherwise(n))
    rows = cells.withColumn("time", time).withColumn("name", _place(others, EVENT_KEYS)).where("time IS NOT NULL AND name IS NOT NULL")
    log = rows.select("subject_id", F.get("cells", F.col("time")).alias("time"), F.get("cells", F.col("name")).alias("event"))
    return event_log(log, name="event", keep_exits=keep_exits)
