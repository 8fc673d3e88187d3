"""Raw signal files to array columns.

Decoding needs numpy, so it runs over ``binaryFile`` rows in ``mapInArrow``; one
bad file becomes a row with a reject reason and never fails the job.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill import schemas
from pulsemill.functions import spectral
from pulsemill.functions.batches import Task, bounded, tidy

PPG_LEN = 300
ECG_FS_RAW, ECG_FS_OUT, ECG_LEN = 1000.0, 30.0, 300
#: bytes of files, and samples, that a task works on at a time
BYTES, SAMPLES = 1 << 20, 1 << 17


def _decoding(unpack: Callable[[bytes], dict], schema: T.StructType) -> Task:
    """One row per (path, content): the unpacked columns, or the reason there are none."""
    series = pa.list_(pa.float32())
    kinds = {"record_id": pa.string(), "reject_reason": pa.string(), "sig_name": pa.list_(pa.string()),
             "p_signal": pa.list_(series),
             "x": pa.list_(series) if schema == schemas.MATRIX_ARRAY else series}
    arrow = pa.schema([(name, kinds[name]) for name in schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, "content", BYTES)):
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                row = {"record_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0]}
                try:
                    row.update(unpack(content))
                except Exception as problem:  # noqa: BLE001 - kept as the row's reject reason
                    row["reject_reason"] = str(problem)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _decode(files: DataFrame, unpack: Callable[[bytes], dict], schema: T.StructType) -> DataFrame:
    return files.select("path", "content").mapInArrow(tidy(_decoding(unpack, schema)), schema)


def _window(ndim: int, flat: bool) -> Callable[[bytes], dict]:
    def unpack(content: bytes) -> dict:
        array = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
        if flat:
            array = array.reshape(-1)
        if array.ndim != ndim:
            raise ValueError(f"expected {ndim} dimensions, got shape {array.shape}")
        return {"x": array if ndim == 1 else list(array)}

    return unpack


def decode_windows(files: DataFrame, ndim: int = 1, flat: bool = False) -> DataFrame:
    """``.npy`` contents as float arrays of the given rank; ``flat`` takes any rank, in row order."""
    return _decode(files, _window(ndim, flat), schemas.WINDOW_ARRAY if ndim == 1 else schemas.MATRIX_ARRAY)


def decode_raw_ppg(files: DataFrame) -> DataFrame:
    """``.npz`` contents with ``p_signal`` (samples, channels) and ``sig_name``."""

    def unpack(content: bytes) -> dict:
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            signal = np.atleast_2d(np.asarray(data["p_signal"], dtype=np.float32))
            return {"sig_name": [str(n) for n in data["sig_name"]], "p_signal": list(signal)}

    return _decode(files, unpack, schemas.RAW_PPG)


def signal_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def read_windows(spark: SparkSession, folder: str) -> DataFrame:
    return decode_windows(signal_files(spark, folder, "*.npy"))


def read_ecg(spark: SparkSession, folder: str) -> DataFrame:
    """ECG windows; a file with one column or one row too many dimensions is one series."""
    return decode_windows(signal_files(spark, folder, "*.npy"), flat=True)


def read_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return decode_windows(signal_files(spark, folder, "*.npy"), ndim=2)


def read_raw_ppg(spark: SparkSession, folder: str) -> DataFrame:
    return decode_raw_ppg(signal_files(spark, folder, "*.npz"))


def green_channel(sig_name: Column, p_signal: Column) -> Column:
    """The analysis channel: named green, else the middle of three, else everything in a row."""
    names = F.transform(sig_name, F.upper)
    named = F.array_position(
        F.transform(names, lambda n: n.contains("PPG_G") | n.contains("GREEN")), True
    )
    channels = F.size(F.get(p_signal, F.lit(0)))
    index = (
        F.when((channels != F.size(names)) | (channels < 2), None)
        .when(named > 0, (named - 1).cast("int"))
        .when(channels == 3, 1)
    )
    return F.when(
        index.isNotNull(), F.transform(p_signal, lambda r: F.get(r, index))
    ).otherwise(F.flatten(p_signal))


def extract_ppg(raw: DataFrame, length: int = PPG_LEN) -> DataFrame:
    """(record_id, ppg, reject_reason): one window per record, or the reason there is none."""
    x = green_channel(F.col("sig_name"), F.col("p_signal"))
    return (
        raw.withColumn("x", F.when(F.col("reject_reason").isNull(), x))
        .withColumn(
            "reject_reason",
            F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(
                ~F.coalesce(F.size("x") == length, F.lit(False)),
                F.format_string("unexpected window length %d, expected %d", F.size("x"), F.lit(length)),
            ),
        )
        .select(
            "record_id",
            F.when(F.col("reject_reason").isNull(), F.col("x")).cast("array<float>").alias("ppg"),
            "reject_reason",
        )
    )


def _resampling(column: str) -> Task:
    """The column's windows at the PPG rate, cut to its length, as ``ecg``; other columns stay. Null and empty windows give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, column, SAMPLES)):
            ecg = spectral.resampled(batch.column(column), ECG_FS_RAW, ECG_FS_OUT, ECG_LEN).cast(pa.list_(pa.float32()))
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, "ecg", ecg)

    return run


def ecg_on_ppg_grid(ecg: DataFrame, column: str = "x") -> DataFrame:
    """ECG windows resampled to the PPG rate and cut to its length.

    A pass over the rows, not a column: Spark repeats a column's function where a later explode
    or filter uses it, and each copy holds a Python worker per core.
    """
    schema = T.StructType([ecg.schema["record_id"], T.StructField("ecg", T.ArrayType(T.FloatType()))])
    return ecg.select("record_id", column).mapInArrow(tidy(_resampling(column)), schema)


def ecg_files_on_grid(files: DataFrame) -> DataFrame:
    """(record_id, ecg, reject_reason) of ``.npy`` contents of any rank: decoded and resampled by one worker per task."""
    decode, resample = _decoding(_window(1, True), schemas.WINDOW_ARRAY), _resampling("x")
    names = schemas.WINDOW_ARRAY.names
    schema = T.StructType([T.StructField("ecg", T.ArrayType(T.FloatType())) if n == "x" else schemas.WINDOW_ARRAY[n] for n in names])
    return files.select("path", "content").mapInArrow(tidy(lambda batches: resample(decode(batches))), schema)
