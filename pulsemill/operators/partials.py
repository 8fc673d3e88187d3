"""Evaluation from partial aggregates that are kept per source and merged when sources come.

A source (a prediction file, a day) is counted once: rows with the same run, score, truth and
decision become one row with their number, error sums become one row per run. These rows are
written below ``store/source=<name>``, replacing those of an earlier write of that source, so
adding it again changes nothing. Reports read the store alone: adding a source reads that
source and none of the others, and all reports equal those of the whole table (error averages
up to the last digits, as they are sums of sums). A run may spread over many sources.

Null sources of a column count as in ``metrics``: rows without a readable answer are counted but
not scored, scores that are null take no part in the curve. An empty source leaves no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsemill.operators import metrics

KEYS = ("run_id", "task", "prob_good", "truth", "decided", "readable")
SUMS = {"n": "long", "n_invalid": "long", "n_error": "long", "sum_error": "double", "sum_square": "double"}
SCHEMA = (
    "run_id string, task string, prob_good double, truth double, decided double, readable boolean, "
    + ", ".join(f"{name} {kind}" for name, kind in SUMS.items())
)


def partial(predictions: DataFrame) -> DataFrame:
    """Counts and sums of a prediction table with ``run_id``."""
    quality = F.col("task") == "quality"
    error = F.when(~quality & F.col("y_pred").isNotNull(), F.col("y_true").cast("double") - F.col("y_pred"))
    return predictions.select(
        "run_id", "task", F.when(quality, F.col("prob_good")).cast("double").alias("prob_good"),
        F.when(quality, F.col("y_true")).cast("double").alias("truth"), F.when(quality, F.col("y_pred")).cast("double").alias("decided"),
        F.col("y_pred").isNotNull().alias("readable"), (F.col("parse_status") == "invalid").alias("invalid"), error.alias("error"),
    ).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("invalid").alias("n_invalid"), F.count("error").alias("n_error"),
        F.coalesce(F.sum(F.abs("error")), F.lit(0.0)).alias("sum_error"), F.coalesce(F.sum(F.col("error") * F.col("error")), F.lit(0.0)).alias("sum_square"),
    )


def add(predictions: DataFrame, store: str, source: str) -> None:
    """Count ``predictions`` into the store as ``source``; no other source is read."""
    if not source:
        raise ValueError("a source needs a name")
    partial(predictions).write.mode("overwrite").parquet(f"{store.rstrip('/')}/source={quote(source, safe='')}")


def merged(spark: SparkSession, store: str) -> DataFrame:
    """The counts of all sources together."""
    rows = spark.read.schema(SCHEMA).parquet(f"{store.rstrip('/')}/source=*")
    return rows.groupBy(*KEYS).agg(*(F.sum(c).cast(kind).alias(c) for c, kind in SUMS.items()))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _cells(decided: Column) -> list[Column]:
    cells = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    return [_count((F.col("truth") == t) & (decided == d)).alias(name) for name, t, d in cells]


def roc_auc(counts: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """As ``metrics.roc_auc`` of the scored rows."""
    scores = counts.where("readable AND prob_good IS NOT NULL").groupBy(*by, "prob_good").agg(
        _count(F.col("truth") == 1).alias("pos"), _count(F.col("truth") == 0).alias("neg")
    )
    return metrics.auc_of_counts(scores, by)


def evaluate(counts: DataFrame) -> DataFrame:
    """The columns and rows of ``metrics.evaluate``, from merged counts."""
    keys = ["run_id", "task"]
    mixed = F.raise_error(F.concat(F.lit("several tasks in one run: "), F.col("run_id")))
    sums = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_records"), _count(F.col("readable")).alias("n_scored"), F.sum("n_invalid").alias("n_invalid_responses"),
        *_cells(F.col("decided")), F.sum("n_error").alias("n_error"), F.sum("sum_error").alias("e"), F.sum("sum_square").alias("s"),
    )
    tasks = F.count(F.lit(1)).over(W.partitionBy("run_id"))  # a row per run and task here
    sums = sums.withColumn("_tasks", tasks).where(F.when(F.col("_tasks") == 1, True).otherwise(mixed)).drop("_tasks")
    auc = roc_auc(counts.where("task = 'quality'"), keys).drop("n_with_score")
    is_quality = (F.col("task") == "quality") & (F.col("n_scored") > 0)
    is_hr = (F.col("task") == "hr") & (F.col("n_error") > 0)
    cells = ("tn", "fp", "fn", "tp")
    return sums.join(auc, keys, "left").select(
        *keys, "n_records", "n_scored", "n_invalid_responses",
        (F.col("n_invalid_responses") / F.col("n_records")).alias("invalid_response_fraction"),
        F.when(is_quality, metrics.macro_f1()).alias("macro_f1"), F.when(is_quality, metrics.accuracy()).alias("accuracy"),
        F.when(is_quality, F.col("roc_auc")).alias("roc_auc"),
        F.when(is_hr, F.col("e") / F.col("n_error")).alias("mae"), F.when(is_hr, F.sqrt(F.col("s") / F.col("n_error"))).alias("rmse"),
        *[F.when(is_quality, F.col(c)).alias(c) for c in cells],
        *[F.when(is_quality, c).alias(name) for name, c in metrics.class_scores().items()],
    )


def threshold_curve(counts: DataFrame, steps: int = metrics.STEPS) -> DataFrame:
    """As ``metrics.threshold_curve`` of the quality runs."""
    rows = counts.where("task = 'quality'").withColumnRenamed("truth", "y_true")
    return metrics.threshold_curve(rows, steps=steps, weight="n")
