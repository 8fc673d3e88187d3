"""Comparison tables over a run ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.functions import labels
from pulsemill.operators.scale import join_dimension
from pulsemill.schemas import VARIANTS


def newest_first(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("created_at"), F.desc("run_id"))


def latest_finished(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest finished run per key; aggregation only, nothing is sorted."""
    done = ledger.where("status = 'finished'")
    return (
        done.groupBy(*keys)
        .agg(F.max_by(F.struct(*done.columns), F.struct("created_at", "run_id")).alias("r"))
        .select("r.*")
    )


def labelled(ledger: DataFrame) -> DataFrame:
    """Ledger with the comparison label, its table row and the input variant."""
    entries = ("method", "llm_id", "ecg_init", "split")
    # config entries become plain columns first, so that each is read from the VARIANT once
    plain = ledger.withColumns(
        {
            **{f"_{e}": labels.config_value(F.col("config"), e) for e in entries},
            "variant": labels.input_variant(F.col("config")),
        }
    ).drop("config")
    label = labels.run_label(*[F.col(c) for c in ("model", "task", "_method", "_llm_id", "_ecg_init")])
    return (
        plain.withColumn("label", label)
        .withColumn("family", labels.row_family(F.col("label")))
        .withColumnRenamed("_split", "split_path")
        .drop("_method", "_llm_id", "_ecg_init")
    )


def newest_by_entries(ledger: DataFrame) -> DataFrame:
    """The newest finished run per model, task and config entries, labelled.

    A label depends on these alone, so only the few runs that are left get one.
    """
    entries = ("method", "llm_id", "ecg_init")
    done = ledger.where("status = 'finished'").select(
        "run_id", "created_at", "status", "metrics", "model", "task",
        *[labels.config_value(F.col("config"), e).alias(f"_{e}") for e in entries],
        labels.input_variant(F.col("config")).alias("variant"),
    )
    left = latest_finished(done, ["model", "task", *[f"_{e}" for e in entries], "variant"])
    label = labels.run_label(*[F.col(c) for c in ("model", "task", "_method", "_llm_id", "_ecg_init")])
    return left.withColumn("label", label).withColumn("family", labels.row_family(F.col("label")))


def main_table(ledger: DataFrame) -> DataFrame:
    """One row per model family in fixed order; families without a run keep an empty row."""
    spark = ledger.sparkSession
    best = latest_finished(newest_by_entries(ledger).where("variant = 'ppg'"), ["family", "task"])
    wide = best.groupBy("family").agg(
        F.max_by("label", (F.col("task") == "quality").cast("int")).alias("label"),
        *[
            F.max(F.when(F.col("task") == task, F.col(f"metrics.{m}"))).alias(f"{task}_{m}")
            for task, m in (
                ("quality", "macro_f1"), ("quality", "roc_auc"), ("quality", "accuracy"),
                ("hr", "mae"), ("hr", "rmse"),
            )
        ],
    )
    order = spark.createDataFrame(list(enumerate(labels.MAIN_ORDER)), "row INT, family STRING")
    return (
        order.join(wide, "family", "left")
        .withColumn("model", F.coalesce("label", "family"))
        .orderBy("row")
        .select(
            "row", "model", "quality_macro_f1", "quality_roc_auc", "quality_accuracy",
            "hr_mae", "hr_rmse",
        )
    )


def extended_table(ledger: DataFrame) -> DataFrame:
    """Quality Macro-F1 by input variant for the models that take more inputs."""
    spark = ledger.sparkSession
    runs = newest_by_entries(ledger.where("task = 'quality'")).where(F.col("label").isin(*labels.EXTENDED_ROWS))
    best = latest_finished(runs, ["label", "variant"])
    wide = (
        best.select("label", "variant", "metrics.macro_f1")
        .groupBy("label")
        .pivot("variant", list(VARIANTS))
        .agg(F.max("macro_f1"))
    )
    order = spark.createDataFrame(list(enumerate(labels.EXTENDED_ROWS)), "row INT, label STRING")
    return (
        order.join(wide, "label", "left")
        .orderBy("row")
        .select("row", F.col("label").alias("model"), *VARIANTS)
    )


def low_data_runs(ledger: DataFrame, splits: DataFrame) -> DataFrame:
    """Finished runs whose split is a low-data split that still exists."""
    split_id = F.regexp_extract("split_path", r"([^/]+)\.json$", 1)
    blocks = (
        splits.where("fraction IS NOT NULL")
        .groupBy("split_id")
        .agg(
            F.max("fraction").alias("fraction"),
            F.max("n_train_subjects").alias("n_train_subjects"),
        )
    )
    runs = labelled(ledger.where("status = 'finished'")).withColumn("split_id", split_id)
    keyed = runs.select("split_id", F.col("label").alias("model"), "task", "metrics")
    return join_dimension(keyed, blocks, "split_id")


def seed_spread(runs: DataFrame) -> DataFrame:
    """Mean and population std over seeds per (model, task, fraction).

    ``n_seeds`` counts all runs; runs without the metric are left out of the mean.
    """
    primary = F.when(F.col("task") == "quality", F.col("metrics.macro_f1")).otherwise(
        F.col("metrics.mae")
    )
    quality_only = lambda m: F.avg(F.when(F.col("task") == "quality", F.col(f"metrics.{m}")))
    return (
        runs.groupBy("model", "task", "fraction")
        .agg(
            F.max("n_train_subjects").alias("n_train_subjects"),
            F.count(F.lit(1)).alias("n_seeds"),
            F.avg(primary).alias("mean"),
            F.stddev_pop(primary).alias("std"),
            quality_only("roc_auc").alias("roc_auc"),
            quality_only("accuracy").alias("accuracy"),
            F.avg(F.when(F.col("task") == "hr", F.col("metrics.rmse"))).alias("rmse"),
        )
        .withColumn("metric", F.when(F.col("task") == "quality", "macro_f1").otherwise("mae"))
        .orderBy("model", "task", "fraction")
    )


def run_list(ledger: DataFrame) -> DataFrame:
    """The run overview, newest first, with each run's headline metric."""
    return newest_first(ledger).select(
        "run_id",
        "model",
        "task",
        "status",
        "created_at",
        labels.primary_metric(
            F.col("task"), F.col("metrics.macro_f1"), F.col("metrics.mae")
        ).alias("primary"),
    )
