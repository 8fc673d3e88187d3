"""Data checks. Each returns the offending rows; an empty result means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill.schemas import FOLDS, PARSE_STATUSES, PREDICTIONS, REGISTRY, TASKS


def require_columns(df: DataFrame, schema: T.StructType | Sequence[str], what: str) -> DataFrame:
    names = schema.names if isinstance(schema, T.StructType) else list(schema)
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col(key).cast("string").alias("record_id"), F.lit("duplicate").alias("problem"))
    )


def outside_domain(df: DataFrame, column: str, allowed: Sequence, problem: str) -> DataFrame:
    """Rows whose non-null value is none of ``allowed``."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(
        F.col("record_id").cast("string").alias("record_id"), F.lit(problem).alias("problem")
    )


def registry_violations(registry: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Duplicate ids, labels other than 0/1/null and, if given, unknown data set names."""
    out = duplicate_keys(registry, "record_id").unionByName(
        outside_domain(registry, "quality_label", (0, 1), "quality_label")
    )
    if datasets:
        known = F.coalesce(F.col("dataset").isin(*datasets), F.lit(False))
        out = out.unionByName(
            registry.where(~known).select("record_id", F.lit("dataset").alias("problem"))
        )
    return out


def prediction_violations(predictions: DataFrame) -> DataFrame:
    """Duplicate ids, unknown tasks and unknown parse states."""
    bad_task = predictions.where(~F.coalesce(F.col("task").isin(*TASKS), F.lit(False)))
    return (
        duplicate_keys(predictions, "record_id")
        .unionByName(bad_task.select("record_id", F.lit("task").alias("problem")))
        .unionByName(outside_domain(predictions, "parse_status", PARSE_STATUSES, "parse_status"))
    )


def mixed_task_runs(predictions: DataFrame, by: str = "run_id") -> DataFrame:
    """Runs whose prediction set does not hold exactly one task."""
    return (
        predictions.groupBy(by).agg(F.count_distinct("task").alias("n_tasks")).where("n_tasks <> 1")
    )


def unscorable_runs(predictions: DataFrame, by: str = "run_id") -> DataFrame:
    """Runs without a single readable prediction."""
    return (
        predictions.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n_records"), F.count("y_pred").alias("n_scored"))
        .where("n_scored = 0")
        .select(by, "n_records")
    )


def mart_gaps(mart: DataFrame) -> DataFrame:
    """Folds without rows, and rows without record_id, subject_id or answer."""
    require_columns(mart, ["record_id", "subject_id", "answer"], "prompt mart")
    counts = mart.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(
            F.col("record_id").isNull() | F.col("subject_id").isNull() | F.col("answer").isNull()
        ).alias("n_incomplete"),
    )
    folds = mart.sparkSession.createDataFrame([(f,) for f in FOLDS], "split STRING")
    return (
        folds.join(counts, "split", "left")
        .fillna(0, ["n", "n_incomplete"])
        .where("n = 0 OR n_incomplete > 0")
    )


def small_splits(registry: DataFrame, least: int = 3) -> DataFrame:
    """One row if the registry has too few subjects to split."""
    return registry.agg(F.count_distinct("subject_id").alias("n_subjects")).where(
        F.col("n_subjects") < least
    )


def first_offenders(violations: DataFrame, n: int = 5) -> DataFrame:
    """A few offenders in id order, for an error text."""
    return violations.orderBy("record_id", "problem").limit(n)


def require_valid(violations: DataFrame, what: str) -> None:
    """Fail with the first offenders if a check found any."""
    found = first_offenders(violations).collect()
    if found:
        listed = ", ".join(f"{r['record_id']} ({r['problem']})" for r in found)
        raise ValueError(f"{what} is invalid: {listed}")


def require_registry(registry: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    require_columns(registry, REGISTRY, "registry")
    require_valid(registry_violations(registry, datasets), "registry")
    return registry


def require_predictions(predictions: DataFrame) -> DataFrame:
    require_columns(predictions, PREDICTIONS, "predictions")
    require_valid(prediction_violations(predictions), "predictions")
    return predictions


def require_task(predictions: DataFrame, task: str) -> DataFrame:
    require_valid(wrong_task_rows(predictions, task), f"{task} report input")
    return predictions


def only_task(predictions: DataFrame, task: str) -> DataFrame:
    """The same rows; the job fails at the first one of another task. Costs no pass of its own."""
    error = F.raise_error(F.concat(F.lit(f"not a {task} row: "), F.col("record_id")))
    return predictions.where(F.when(F.col("task").eqNullSafe(task), True).otherwise(error))


def filled(report: DataFrame, count: str, what: str) -> DataFrame:
    """The same report; the job fails if ``count`` says that it was made of no rows."""
    return report.where(F.when(F.col(count) > 0, True).otherwise(F.raise_error(F.lit(f"{what}: no rows"))))


def wrong_task_rows(predictions: DataFrame, task: str) -> DataFrame:
    """Rows of a report input that are of another task, or of none."""
    return predictions.where(~F.col("task").eqNullSafe(task)).select(
        "record_id", F.lit(f"not a {task} row").alias("problem")
    )


def require_disjoint(split: DataFrame) -> DataFrame:
    from pulsemill.operators.splits import overlapping_subjects

    shared = overlapping_subjects(split).select(
        F.col("subject_id").alias("record_id"), F.col("folds").alias("problem")
    )
    require_valid(shared, "split")
    return split
