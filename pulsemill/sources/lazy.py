"""Array files whose shape and type are read first, and their samples only if these fit.

Files are listed with their lengths and no content; a task opens each, reads the header of
the array (some hundred bytes), and goes on only if rank, shape and type are the wanted ones
and the file is as long as they say. Everything else becomes a row with a reject reason. The
files must be on a file system that Arrow opens; ``signals`` decodes what Spark alone reads.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "record_id string, shape array<long>, x array<float>, reject_reason string"


def listed(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """(path, length) of the files of a folder; no file is opened, and Spark lists no empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address as Spark lists it, in which nothing is escaped, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def array_header(source) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether columns come first, and type of the array that ``source`` holds; it then stands at the samples."""
    version = npy.read_magic(source)
    read = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"unknown version {version} of an array file")
    return read(source)


def samples(source, size: int | None, shape: Sequence[int | None] | None) -> tuple[tuple[int, ...], np.ndarray]:
    """The array's shape and its samples in row order, or a ValueError that was found without reading them.

    ``size`` is the length of the file, if known; in ``shape`` a None fits any length.
    """
    found, by_column, kind = array_header(source)
    if shape is not None and (len(found) != len(shape) or any(w is not None and f != w for f, w in zip(found, shape, strict=True))):
        raise ValueError(f"expected shape {tuple(shape)}, got {found}".replace("None", "any"))
    if kind.kind not in "fiub":
        raise ValueError(f"expected numbers, got {kind}")
    n = math.prod(found)
    if size is not None and size - source.tell() != n * kind.itemsize:
        raise ValueError(f"expected {n * kind.itemsize} bytes of samples, got {size - source.tell()}")
    content = source.read(n * kind.itemsize)
    if len(content) != n * kind.itemsize:
        raise ValueError(f"expected {n * kind.itemsize} bytes of samples, got {len(content)}")
    x = np.frombuffer(content, kind).astype(np.float32)
    return found, (x.reshape(found, order="F").ravel() if by_column else x)


def read_arrays(files: DataFrame, shape: Sequence[int | None] | None = (None,), member: str | None = None) -> DataFrame:
    """(record_id, shape, x, reject_reason) of (path, length) rows; ``x`` is in row order.

    ``shape`` is what an array must have (None in it: any length; None: any shape). With
    ``member`` the files are archives of arrays, of which that one is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.string()), ("shape", pa.list_(pa.int64())), ("x", pa.list_(pa.float32())), ("reject_reason", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                row = {"record_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0]}
                try:
                    fs, at = opened(path)
                    with fs.open_input_file(at) as source:
                        if member is None:
                            row["shape"], row["x"] = samples(source, size, shape)
                        else:
                            with zipfile.ZipFile(source) as archive, archive.open(f"{member}.npy") as inner:
                                row["shape"], row["x"] = samples(inner, archive.getinfo(f"{member}.npy").file_size, shape)
                except (ValueError, KeyError, zipfile.BadZipFile, OSError) as problem:
                    row["reject_reason"] = str(problem)
                rows.append(row)
                held += len(row.get("x", ()))
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select(F.col("path").cast("string").alias("path"), F.col("length").cast("long").alias("length")).mapInArrow(run, SCHEMA)


def read_windows(spark: SparkSession, folder: str, length: int | None = None) -> DataFrame:
    """One-dimensional windows of ``length`` samples, or of any number."""
    return read_arrays(listed(spark, folder), (length,))
