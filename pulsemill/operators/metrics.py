"""Scoring prediction tables.

Every metric is a conditional aggregate per run, combined map-side, so a run that
holds most of the rows costs no more than many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill.operators.scale import EARLIER, require_rows
from pulsemill.schemas import INT, LONG, REAL, table

STEPS = 199


def scored(predictions: DataFrame) -> DataFrame:
    """Rows with a readable answer."""
    return predictions.where("y_pred IS NOT NULL")


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.when(b == 0, 0.0).otherwise(a / b).cast("double")


def _share(a: Column, b: Column) -> Column:
    """a / b with null for an empty denominator."""
    return F.when(b == 0, None).otherwise(a / b).cast("double")


def confusion_columns(truth: Column, decided: Column) -> list[Column]:
    """Counts of the four cells; class 1 is good."""

    def cell(t: int, p: int) -> Column:
        return F.count_if((truth == t) & (decided == p))

    return [
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(1, 1).alias("tp"),
    ]


def class_scores() -> dict[str, Column]:
    """Precision, recall, F1 and support per class from the four cells."""
    out = {}
    for name, hit, false_alarm, miss in (("bad", "tn", "fn", "fp"), ("good", "tp", "fp", "fn")):
        hit, false_alarm, miss = F.col(hit), F.col(false_alarm), F.col(miss)
        out[f"{name}_precision"] = _ratio(hit, hit + false_alarm)
        out[f"{name}_recall"] = _ratio(hit, hit + miss)
        out[f"{name}_f1"] = _ratio(2.0 * hit, 2 * hit + false_alarm + miss)
        out[f"{name}_support"] = hit + miss
    return out


def macro_f1() -> Column:
    """Mean F1 over the classes found in truth or prediction."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    wrong = fp + fn
    present = F.when(tn + wrong > 0, 1).otherwise(0) + F.when(tp + wrong > 0, 1).otherwise(0)
    return _ratio(
        _ratio(2.0 * tn, 2 * tn + wrong) + _ratio(2.0 * tp, 2 * tp + wrong), present
    )


def accuracy() -> Column:
    return _ratio(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*confusion_columns(F.col("y_true"), F.col("y_pred")))


def confusion_matrix() -> Column:
    """Rows = truth, columns = prediction, both ordered bad, good."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def _pairs_in_order(by: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Count one partition of rows sorted by (run, score): one row per run met in it.

    ``inside`` is the number of (good, bad) pairs in order among the partition's own rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        totals: dict[tuple, list] = {}  # the run at hand only
        last = None

        def row(run: tuple) -> pd.DataFrame:
            return pd.DataFrame([(*run, part, *totals.pop(run))], columns=[*by, "part", "pos", "neg", "inside"])

        for batch in batches:
            for run, rows in batch.groupby(by, sort=False, dropna=False):
                if run != last and last in totals:  # rows are sorted: that run is complete
                    yield row(last)
                last = run
                seen = totals.setdefault(run, [0, 0, 0.0])
                p, n = rows["pos"].to_numpy(), rows["neg"].to_numpy()
                seen[2] += float((p * (seen[1] + n.cumsum() - 0.5 * n)).sum())
                seen[0] += int(p.sum())
                seen[1] += int(n.sum())
        if last is not None:
            yield row(last)

    return count


def roc_auc(rows: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null for a single class.

    The area is the share of (good, bad) pairs in order. Equal scores are merged,
    so copies cost nothing, then all scores are range-sorted: a run that holds
    most rows spreads over many partitions. Each partition counts its own pairs;
    pairs across partitions follow from one row per (run, partition).
    """
    by = list(by)
    merged = (
        rows.where("prob_good IS NOT NULL")
        .groupBy(*by, "prob_good")
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"),
             F.count_if(F.col("y_true") == 0).alias("neg"))
    )
    return auc_of_counts(merged, by)


def auc_of_counts(merged: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """As :func:`roc_auc`, from one row per run and ``prob_good`` with the counts ``pos`` and ``neg``."""
    by = list(by)
    counts = table(part=INT, pos=LONG, neg=LONG, inside=REAL)
    counted = (
        merged.repartitionByRange(*by, "prob_good")
        .sortWithinPartitions(*by, "prob_good")
        .select(*by, "pos", "neg")
        .mapInPandas(_pairs_in_order(by), T.StructType([*merged.select(*by).schema, *counts]))
    )
    earlier = W.partitionBy(*by).orderBy("part").rowsBetween(*EARLIER)
    below = F.coalesce(F.sum("neg").over(earlier), F.lit(0)).cast("double")
    return (
        counted.withColumn("pairs", F.col("inside") + F.col("pos") * below)
        .groupBy(*by)
        .agg(
            F.try_divide(
                F.sum("pairs"), F.sum("pos").cast("double") * F.sum("neg").cast("double")
            ).alias("roc_auc"),
            (F.sum("pos") + F.sum("neg")).alias("n_with_score"),
        )
    )


def quality_metrics(predictions: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """n, Macro-F1, accuracy, per-class scores, confusion matrix and AUC per run."""
    rows = scored(predictions)
    scores = confusion(rows, by).select(
        *by,
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        macro_f1().alias("macro_f1"),
        accuracy().alias("accuracy"),
        *[c.alias(name) for name, c in class_scores().items()],
        confusion_matrix().alias("confusion_matrix"),
    )
    return scores.join(roc_auc(rows, by).drop("n_with_score"), list(by), "left")


def error_columns(truth: Column, predicted: Column) -> list[Column]:
    """n, MAE, RMSE and the rows the error could not be taken of."""
    error = truth - predicted
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count_if(error.isNull()).alias("n_null"),
    ]


def hr_metrics(predictions: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    return scored(predictions).groupBy(*by).agg(*error_columns(F.col("y_true"), F.col("y_pred")))


def evaluate(predictions: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """One summary row per run: row counts, invalid share, and the metrics of its task.

    Quality runs have the four cells and the scores per class too. A run with rows of
    two tasks is an error.
    """
    keys = [*by, "task"]
    readable = F.col("y_pred").isNotNull()
    error = F.when(readable, F.col("y_true") - F.col("y_pred"))
    counts = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(readable).alias("n_scored"),
        F.count_if(F.col("parse_status") == "invalid").alias("n_invalid_responses"),
        *confusion_columns(F.col("y_true"), F.col("y_pred")),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
    mixed = F.raise_error(F.concat(F.lit("several tasks in one run: "), F.concat_ws(", ", *by)))
    tasks = F.count(F.lit(1)).over(W.partitionBy(*by))  # a row per run and task here
    counts = counts.withColumn("_tasks", tasks).where(F.when(F.col("_tasks") == 1, True).otherwise(mixed)).drop("_tasks")
    auc = roc_auc(scored(predictions).where("task = 'quality'"), keys).drop("n_with_score")
    is_quality = (F.col("task") == "quality") & (F.col("n_scored") > 0)
    is_hr = F.col("task") == "hr"
    cells = ("tn", "fp", "fn", "tp")
    return counts.join(auc, keys, "left").select(
        *keys,
        "n_records",
        "n_scored",
        "n_invalid_responses",
        (F.col("n_invalid_responses") / F.col("n_records")).alias("invalid_response_fraction"),
        F.when(is_quality, macro_f1()).alias("macro_f1"),
        F.when(is_quality, accuracy()).alias("accuracy"),
        F.when(is_quality, F.col("roc_auc")).alias("roc_auc"),
        F.when(is_hr, F.col("mae")).alias("mae"),
        F.when(is_hr, F.col("rmse")).alias("rmse"),
        *[F.when(is_quality, F.col(c)).alias(c) for c in cells],
        *[F.when(is_quality, c).alias(name) for name, c in class_scores().items()],
    )


def report_json(evaluated: DataFrame) -> DataFrame:
    """The report of each run as one JSON text, with the full metrics block of its task."""

    def per_class(name: str) -> Column:
        scores = ("precision", "recall", "f1", "support")
        return F.struct(*[F.col(f"{name}_{s}").alias(s) for s in scores])

    quality = F.struct(
        F.col("n_scored").alias("n"), "macro_f1", "accuracy",
        F.struct(per_class("bad").alias("0"), per_class("good").alias("1")).alias("per_class"),
        confusion_matrix().alias("confusion_matrix"),
        F.array(F.lit("bad"), F.lit("good")).alias("confusion_matrix_labels"),
        "roc_auc",
    )
    hr = F.struct(F.col("n_scored").alias("n"), "mae", "rmse")
    readable = F.col("n_scored") > 0
    head = ("task", "n_records", "n_scored", "n_invalid_responses", "invalid_response_fraction")
    keep = {"ignoreNullFields": "false"}
    return evaluated.select(
        "run_id",
        F.when(
            F.col("task") == "quality",
            F.to_json(F.struct(*head, F.when(readable, quality).alias("metrics")), keep),
        ).otherwise(F.to_json(F.struct(*head, F.when(readable, hr).alias("metrics")), keep)).alias("report"),
    )


def threshold_curve(
    rows: DataFrame, by: Sequence[str] = ("run_id",), steps: int = STEPS, weight: str | None = None
) -> DataFrame:
    """Macro-F1 at every grid threshold k / (steps + 1), k = 1..steps.

    A score counts as good for all k up to its own grid step, so one count per
    step and two running sums over the grid replace steps x rows comparisons. A row
    stands for as many as its ``weight`` says.
    """
    by = list(by)
    weight = F.lit(1) if weight is None else F.col(weight)
    width = F.lit(1.0 / (steps + 1))
    score = F.col("prob_good")
    guess = F.floor(score * F.lit(float(steps + 1)))
    # the grid is k * width in floating point: correct the guess to agree with score >= k * width
    step = (
        F.when(score >= (guess + 1) * width, guess + 1)
        .when(score < guess * width, guess - 1)
        .otherwise(guess)
    )
    counted = (
        rows.where("prob_good IS NOT NULL")
        .groupBy(*by, F.greatest(F.lit(0), F.least(F.lit(steps), step)).cast("int").alias("k"))
        .agg(
            F.sum(F.when(F.col("y_true") == 1, weight).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("y_true") == 0, weight).otherwise(0)).alias("neg"),
        )
    )
    grid = (
        counted.select(*by).distinct()
        .select(*by, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    )
    filled = grid.join(counted, [*by, "k"], "left").fillna(0, ["pos", "neg"])
    up = W.partitionBy(*by).orderBy("k").rowsBetween(0, W.unboundedFollowing)
    down = W.partitionBy(*by).orderBy("k").rowsBetween(*EARLIER)
    cells = filled.select(
        *by,
        "k",
        (F.col("k") * width).alias("threshold"),
        F.sum("pos").over(up).alias("tp"),
        F.sum("neg").over(up).alias("fp"),
        F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("tn"),
    )
    return cells.where("k > 0").select(*by, "threshold", macro_f1().alias("macro_f1"))


def best_threshold(
    rows: DataFrame, by: Sequence[str] = ("run_id",), steps: int = STEPS
) -> DataFrame:
    """The lowest threshold with the highest Macro-F1. Meant for the validation fold only."""
    return threshold_curve(rows, by, steps).groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("macro_f1"), -F.col("threshold"))).alias("threshold"),
        F.max("macro_f1").alias("macro_f1"),
    )


def fitted_threshold(validation: DataFrame, steps: int = STEPS) -> float:
    """The chosen threshold of one validation fold, as a number."""
    require_rows(validation, "threshold choice")
    one = validation.withColumn("run_id", F.lit("val"))
    return float(best_threshold(one, ["run_id"], steps).first()["threshold"])


def best_epoch(log: DataFrame) -> DataFrame:
    """Per run, the first epoch with the best validation score."""
    score = F.when(F.col("task") == "quality", F.col("macro_f1")).otherwise(-F.col("mae"))
    rank = F.when(score.isNotNull(), F.struct(score.alias("s"), (-F.col("epoch")).alias("e")))
    return log.groupBy("run_id", "task").agg(
        F.max_by("epoch", rank).alias("epoch"),
        F.max(score).alias("score"),
    )
