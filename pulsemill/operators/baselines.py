"""Trivial baselines: each fits one statistic and gives it to every target row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.functions import spectral
from pulsemill.operators.records import prediction_frame, task_rows
from pulsemill.operators.scale import exact_median, require_rows


def fit_majority(train: DataFrame) -> DataFrame:
    """One row: the most common label (the smaller on ties) and the share of good rows."""
    counts = train.groupBy("quality_label").agg(F.count(F.lit(1)).alias("n"))
    label = F.col("quality_label")
    known = F.when(label.isNotNull(), F.struct(F.col("n"), -label))
    return counts.agg(
        F.max_by("quality_label", known).cast("double").alias("majority_label"),
        F.try_divide(
            F.sum(F.when(label == 1, F.col("n")).otherwise(0)), F.sum("n")
        ).alias("prob_good"),
    )


def predict_majority(train: DataFrame, target: DataFrame) -> DataFrame:
    fitted = fit_majority(require_rows(train, "majority class"))
    return prediction_frame(
        target,
        "quality",
        fitted.select("majority_label").scalar(),
        prob_good=fitted.select("prob_good").scalar(),
    )


def fit_median_hr(train: DataFrame) -> DataFrame:
    """One row: the exact median HR over the good training windows."""
    good = require_rows(task_rows(train, "hr"), "median HR")
    return exact_median(
        good.select("hr_ref", F.lit(0).alias("everyone")), "hr_ref", "everyone", "median_hr"
    ).select("median_hr")


def predict_median_hr(train: DataFrame, target: DataFrame) -> DataFrame:
    return prediction_frame(target, "hr", fit_median_hr(train).scalar())


def predict_dominant_frequency(
    target: DataFrame, column: str = "ppg", fs: float = 30.0
) -> DataFrame:
    """HR at the strongest frequency inside the plausible band."""
    return prediction_frame(target, "hr", spectral.dominant_bpm(F.col(column), fs))


def predict_trivial(
    task: str, method: str | None, train: DataFrame, target: DataFrame, fs: float = 30.0
) -> DataFrame:
    """Refit a trivial run's statistic on its training rows and apply it."""
    if task == "quality":
        return predict_majority(train, target)
    if method == "dominant_frequency":
        return predict_dominant_frequency(target, fs=fs)
    return predict_median_hr(train, target)
