"""Incremental landing: each run decodes only the files that arrived since the last one.

The file source remembers in its checkpoint what it has read, so landing again
skips everything landed before, and a lost executor or a restarted job neither
drops nor repeats a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsemill.sources import signals

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def land_new_files(
    spark: SparkSession,
    folder: str,
    pattern: str,
    decode: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    files_per_batch: int = 10_000,
) -> int:
    """Append the decoded new files of ``folder`` to a parquet table; returns the rows added.

    They are counted from the table's footers, before and after.
    """
    before = _rows(spark, table)
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    query = (
        decode(files)
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _rows(spark, table) - before


def _rows(spark: SparkSession, table: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not [f for f in fs.listStatus(path) if f.getPath().getName().endswith(".parquet")]:
        return 0
    return spark.read.parquet(table).count()


def land_ppg(spark: SparkSession, folder: str, table: str, checkpoint: str) -> int:
    return land_new_files(spark, folder, "*.npz", signals.decode_raw_ppg, table, checkpoint)


def land_windows(spark: SparkSession, folder: str, table: str, checkpoint: str) -> int:
    return land_new_files(spark, folder, "*.npy", signals.decode_windows, table, checkpoint)
