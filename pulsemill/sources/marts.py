"""Sinks and scans of the model-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tensor_mart(mart: DataFrame, path: str) -> None:
    """Parquet by task and split: a reader of one fold never opens the others."""
    mart.write.mode("overwrite").partitionBy("task", "split").parquet(path)


def read_tensor_mart(spark: SparkSession, path: str, task: str, split: str) -> DataFrame:
    """One fold; a window without an id gets ``subject_i`` by its position."""
    rows = spark.read.parquet(path).where((F.col("task") == task) & (F.col("split") == split))
    if rows.isEmpty():
        raise ValueError(f"mart has no rows for task {task!r}, split {split!r}")
    return with_record_ids(rows)


def with_record_ids(rows: DataFrame) -> DataFrame:
    if "position" not in rows.columns:
        return rows
    stand_in = F.concat_ws("_", "subject_id", F.col("position").cast("string"))
    return rows.withColumn("record_id", F.coalesce(F.col("record_id"), stand_in))


def write_prompt_mart(mart: DataFrame, path: str) -> None:
    mart.write.mode("overwrite").partitionBy("task", "split").json(path)


def read_prompt_mart(spark: SparkSession, path: str, task: str, split: str, schema) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.where((F.col("task") == task) & (F.col("split") == split))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)
