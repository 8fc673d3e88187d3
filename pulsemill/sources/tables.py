"""Readers and writers of the typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill import schemas
from pulsemill.operators.constraints import (
    require_columns,
    require_disjoint,
    require_predictions,
    require_registry,
    require_valid,
)
from pulsemill.operators.scale import join_dimension
from pulsemill.sources.named import write_single


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Quality and heart-rate annotations; ids stay text. Spark drops a byte-order mark."""
    return spark.read.schema(schemas.ANNOTATIONS).csv(path, header=True)


def read_subject_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SUBJECT_INFO).csv(path, header=True)


def write_registry(registry: DataFrame, path: str, datasets=None) -> None:
    """Validate, keep the contract's columns (and the optional ones present), write."""
    require_registry(registry, datasets)
    optional = [c for c in schemas.REGISTRY_OPTIONAL.names if c in registry.columns]
    registry.select(*schemas.REGISTRY.names, *optional).write.mode("overwrite").parquet(path)


def read_registry(spark: SparkSession, path: str, datasets=None) -> DataFrame:
    """Typed scan of a registry, validated."""
    table = require_columns(spark.read.parquet(path), schemas.REGISTRY, "registry")
    known = {f.name: f.dataType for f in (*schemas.REGISTRY, *schemas.REGISTRY_OPTIONAL)}
    typed = table.select(*[F.col(c).cast(known[c]) for c in table.columns if c in known])
    return require_registry(typed, datasets)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Splits as one row per subject: (split_id, subject_id, fold, low-data block).

    ``path`` holds a table of :func:`write_split`, or published JSON files with three lists each.
    """
    table = _read_split_table(spark, path) if _has_parquet(spark, path) else _read_split_lists(spark, path)
    require_disjoint(table.withColumn("subject_id", F.concat_ws("/", "split_id", "subject_id")))
    return table.select(*schemas.SPLIT.names)


def _has_parquet(spark: SparkSession, path: str) -> bool:
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(pattern) or []) > 0


def _read_split_table(spark: SparkSession, path: str) -> DataFrame:
    none = F.lit(None)
    return spark.read.parquet(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("split_id"),
        "fold", "subject_id", none.cast("double").alias("fraction"), F.col("seed").cast("int").alias("seed"),
        none.cast("int").alias("n_train_subjects"),
    )


def _read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    files = (
        spark.read.schema(schemas.SPLIT_FILE)
        .json(path, multiLine=True)
        .withColumn("split_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    )
    lists = F.array(*[
        F.struct(F.lit(fold).alias("fold"), F.col(f"{fold}_subjects").alias("subjects"))
        for fold in schemas.FOLDS
    ])
    return (
        files.select("split_id", "seed", "low_data", F.explode(lists).alias("part"))
        .select(
            "split_id",
            F.col("part.fold").alias("fold"),
            F.explode("part.subjects").alias("subject_id"),
            F.col("low_data.fraction").alias("fraction"),
            F.coalesce("low_data.seed", "seed").alias("seed"),
            F.col("low_data.n_train_subjects").alias("n_train_subjects"),
        )
    )


def write_split(split: DataFrame, path: str, seed: int, ratios) -> None:
    """A split of any size: a row per subject, with the seed and the ratios it was drawn with."""
    require_disjoint(split)
    split.select(
        "subject_id", "fold", F.lit(seed).alias("seed"),
        F.array(*[F.lit(float(r)) for r in ratios]).alias("ratios"),
    ).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSVs; the run is the directory above ``predictions/``."""
    table = spark.read.schema(schemas.PREDICTIONS).csv(
        path, header=True, multiLine=True, escape='"'
    )
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/predictions/[^/]+$", 1)
    return table.withColumn("run_id", run)


def write_predictions(predictions: DataFrame, path: str) -> None:
    require_predictions(predictions)
    predictions.select(*schemas.PREDICTIONS.names).write.mode("overwrite").csv(
        path, header=True, escape='"'
    )


def write_prediction_table(predictions: DataFrame, path: str) -> None:
    """Predictions of any size as parquet, one folder per run."""
    predictions.select("run_id", *schemas.PREDICTIONS.names).write.mode("append").partitionBy(
        "run_id"
    ).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Run records; a file that is no run record, or has fields that a record does not have, is left out."""
    table = spark.read.schema(schemas.LEDGER).json(path, multiLine=True, mode="DROPMALFORMED")
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    unknown = F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, schemas.LEDGER.names)))) > 0
    strange = whole.where(unknown).select("file_path")
    kept = table.withColumn("file_path", F.col("_metadata.file_path")).join(strange, "file_path", "left_anti")
    return kept.where("run_id IS NOT NULL").select(*schemas.LEDGER.names)


def load_run(ledger: DataFrame, run_id: str) -> DataFrame:
    found = ledger.where(F.col("run_id") == run_id)
    if found.isEmpty():
        raise ValueError(f"no such run: {run_id}")
    return found


def run_predictions(ledger: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions with the model and status of their run."""
    runs = ledger.select("run_id", "model", "status", "created_at")
    return join_dimension(predictions, runs, "run_id")


def unknown_run_values(ledger: DataFrame) -> DataFrame:
    """Runs with an unknown model, task or status."""
    ok = (
        F.col("model").isin(*schemas.MODELS)
        & F.col("task").isin(*schemas.TASKS)
        & F.col("status").isin(*schemas.STATUSES)
    )
    return ledger.where(~F.coalesce(ok, F.lit(False))).select(
        F.col("run_id").alias("record_id"), F.lit("model, task or status").alias("problem")
    )


def require_ledger(ledger: DataFrame) -> DataFrame:
    require_valid(unknown_run_values(ledger), "run ledger")
    return ledger


def write_report(rows: DataFrame, fields: list[str], path: str) -> None:
    """A report as one CSV file with a fixed field order; other columns are dropped.

    Many tasks may write it; the file is there when all of it is (``named``).
    """
    header = F.lit(",".join(fields))
    write_single(rows.select(F.to_csv(F.struct(*fields), {"escape": '"'}).alias("line")), path, first=header)


def write_json(rows: DataFrame, path: str) -> None:
    """A report as one JSON file, a line per row; one row makes a plain JSON object."""
    write_single(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")), path)
