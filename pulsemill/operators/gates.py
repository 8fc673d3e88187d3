"""Reports on the quality gate in front of the HR model, and on activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemill.operators.constraints import filled, only_task
from pulsemill.operators.metrics import _share


def _gate_columns(truth: Column, decided: Column, total: str) -> list[Column]:
    """Counts behind the gate's shares; an unreadable decision is a rejection."""
    accepted = decided.eqNullSafe(1.0)
    return [
        F.count(F.lit(1)).alias(total),
        F.count_if(accepted).alias("n_accepted"),
        F.count_if(~accepted & (truth == 1)).alias("n_false_reject"),
        F.count_if(accepted & (truth == 0)).alias("n_false_accept"),
        F.count_if(truth == 1).alias("n_good"),
        F.count_if(truth == 0).alias("n_bad"),
    ]


def _gate_shares(total: str) -> list[Column]:
    return [
        F.col(total),
        F.col("n_accepted"),
        _share(F.col("n_accepted"), F.col(total)).alias("accepted_fraction"),
        _share(F.col("n_false_reject"), F.col("n_good")).alias("false_reject_rate"),
        _share(F.col("n_false_accept"), F.col("n_bad")).alias("false_accept_rate"),
    ]


def common_windows(quality: DataFrame, hr: DataFrame) -> DataFrame:
    """Windows both files cover, truths and predictions side by side."""
    side = lambda df, tag: df.select(
        "record_id",
        F.col("y_true").alias(f"y_true_{tag}"),
        F.col("y_pred").alias(f"y_pred_{tag}"),
    )
    return side(quality, "quality").join(side(hr, "hr"), "record_id")


def pipeline_report(quality: DataFrame, hr: DataFrame) -> DataFrame:
    """Gate shares and accepted-window HR errors over the windows both files cover.

    A row of the wrong task on either side, and two files without a common window, are errors.
    """
    rows = common_windows(only_task(quality, "quality"), only_task(hr, "hr"))
    accepted = F.col("y_pred_quality").eqNullSafe(1.0)
    error = F.when(accepted, F.col("y_true_hr") - F.col("y_pred_hr"))
    sums = rows.agg(
        *_gate_columns(F.col("y_true_quality"), F.col("y_pred_quality"), "n_windows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count_if(accepted & error.isNull()).alias("n_null"),
    )
    return filled(sums, "n_windows", "common windows").select(*_gate_shares("n_windows"), "mae", "rmse", "n_null")


def accepted_windows(quality: DataFrame, hr: DataFrame) -> DataFrame:
    """HR rows whose window the gate accepted."""
    return hr.join(quality.where("y_pred = 1").select("record_id"), "record_id", "left_semi")


def cascade_report(quality: DataFrame, hr: DataFrame | None = None) -> DataFrame:
    """Gate shares on the full quality table; HR errors on the accepted part of ``hr``."""
    quality = only_task(quality, "quality")
    sums = quality.agg(*_gate_columns(F.col("y_true"), F.col("y_pred"), "n_test"))
    gate = filled(sums, "n_test", "quality predictions").select(*_gate_shares("n_test"))
    if hr is None:
        return gate
    hr = only_task(hr, "hr")
    error = F.col("y_true") - F.col("y_pred")
    on_accepted = accepted_windows(quality, hr).agg(
        F.struct(
            F.count(F.lit(1)).alias("hr_windows_scored"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.count_if(error.isNull()).alias("n_null"),
        ).alias("hr")
    )
    return gate.withColumn("hr", on_accepted.scalar()).select(*gate.columns, "hr.*")


def accepted_share(quality: DataFrame) -> DataFrame:
    """Accepted share over all rows; an unreadable decision is a rejection."""
    return quality.agg(
        F.avg(F.when(F.col("y_pred").eqNullSafe(1.0), 1.0).otherwise(0.0)).alias(
            "accepted_fraction"
        )
    )


def with_activity(hr: DataFrame, registry: DataFrame) -> DataFrame:
    return hr.join(registry.select("record_id", "activity"), "record_id", "left")


def activity_report(hr: DataFrame, registry: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """HR errors overall (activity null) and per activity, with each row's level.

    ``n_windows`` counts all windows of a level, ``n`` those with a readable prediction.
    With quality predictions the overall row bears the share of windows that they accept.
    Rows are reduced to sums per activity first, then the overall row is added up
    from those. Windows without an activity count in the overall row only.
    """
    readable = F.col("y_pred").isNotNull()
    error = F.when(readable, F.col("y_true") - F.col("y_pred"))
    sums = (
        with_activity(only_task(hr, "hr"), registry)
        .groupBy("activity")
        .agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.count_if(readable).alias("n"),
            F.count(error).alias("n_error"),
            F.sum(F.abs(error)).alias("abs_error"),
            F.sum(error * error).alias("sq_error"),
        )
    )
    out = (
        sums.rollup("activity")
        .agg(
            F.grouping("activity").alias("is_total"),
            F.sum("n_windows").alias("n_windows"),
            F.sum("n").alias("n"),
            F.try_divide(F.sum("abs_error"), F.sum("n_error")).alias("mae"),
            F.sqrt(F.try_divide(F.sum("sq_error"), F.sum("n_error"))).alias("rmse"),
        )
        .where((F.col("is_total") == 1) | (F.col("activity").isNotNull() & (F.col("n") > 0)))
    )
    share = F.lit(None).cast("double") if quality is None else accepted_share(only_task(quality, "quality")).scalar()
    return filled(out, "n_windows", "HR predictions").select(
        F.when(F.col("is_total") == 1, "overall").otherwise("activity").alias("level"),
        "activity",
        "n_windows",
        "n",
        "mae",
        "rmse",
        F.when(F.col("is_total") == 1, share).alias("accepted_fraction"),
    )
